"""String functions: ids, keys, messages and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, places: int) -> Column:
    """``value`` with a fixed number of decimals, rounded half-even on its exact binary value.

    ``format_number`` with a pattern does that; ``format_string`` and ``round`` go by the shortest
    decimal form instead and differ on ties.
    """
    return F.call_function("format_number", value, F.lit("0." + "0" * places if places else "0"))


def fixed_half_up(value: Column, places: int) -> Column:
    """Like :func:`fixed`, but an exact tie goes to the larger value.

    An exact tie at ``places`` decimals is an odd multiple of ``2 ** -(places + 1)``; scaling by a
    power of two is exact, so the test is too. Ties are nudged up before formatting.
    """
    scaled = value * float(2 ** (places + 1))
    tie = F.pmod(scaled, F.lit(2.0)) == 1.0
    return fixed(F.when(tie, value + 10.0 ** -(places + 2)).otherwise(value), places)


def round_half_even(value: Column, places: int) -> Column:
    """``value`` rounded to ``places`` decimals, half-even on its exact binary value."""
    return fixed(value, places).cast("double")


def safe_id(project_id: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` stay; all else becomes ``_``. Different ids can collide."""
    return F.regexp_replace(project_id, r"[^\p{L}\p{N}_-]", "_")


def repo_id(repo: Column) -> Column:
    """``owner/name`` to a baseline id: slashes to dashes, lower case."""
    return F.lower(F.translate(repo, "/", "-"))


def stripped(value: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def key_line(function_key: Column) -> Column:
    """Line number of a key ``name@line:...``; 1 when there is none.

    Accepts what an integer literal in text may be: outer blanks, a sign, single underscores between digits.
    """
    after = F.get(F.split(function_key, "@"), F.lit(1))
    number = stripped(F.get(F.split(after, ":"), F.lit(0)))
    whole = number.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")
    line = F.when(whole, F.translate(number, "_", "").try_cast("bigint"))
    return F.coalesce(line, F.lit(1).cast("bigint"))


def key_name(function_key: Column) -> Column:
    """Name part of a key, which moved code keeps."""
    return F.substring_index(function_key, "@", 1)


def start_line(line_number: Column) -> Column:
    """1-based line of a finding, at least 1."""
    return F.greatest(F.lit(1), line_number)


def editor_line(line_number: Column) -> Column:
    """0-based line of a finding, at least 0."""
    return F.greatest(F.lit(0), line_number - 1)


def finding_message(category: Column, node_path: Column, confidence: Column) -> Column:
    return F.concat(category, F.lit(": "), node_path, F.lit(" (confidence="), fixed(confidence, 2), F.lit(")"))


def function_anomaly_message(key: Column, z: Column, distance: Column) -> Column:
    return F.concat(
        F.lit("Structural anomaly in "), key,
        F.lit(" (Anomaly Z="), fixed(z, 2), F.lit(", Mahalanobis="), fixed(distance, 2), F.lit(")"),
    )


def module_anomaly_message(z: Column, distance: Column) -> Column:
    return F.concat(
        F.lit("Module-level structural anomaly (Anomaly Z="), fixed(z, 2),
        F.lit(", Mahalanobis="), fixed(distance, 2), F.lit(")"),
    )


def editor_message(severity: Column, category: Column, node_path: Column, confidence: Column) -> Column:
    percent = fixed_half_up(confidence * 100, 0)
    return F.concat(
        F.lit("["), severity, F.lit("] "), category, F.lit(" | "), node_path,
        F.lit(" | confidence "), percent, F.lit("%"),
    )


def hover_text(severity: Column, category: Column, node_path: Column) -> Column:
    return F.concat(F.lit("["), severity, F.lit("] "), category, F.lit(": "), node_path)


def file_risk_message(tier: Column, score: Column) -> Column:
    return F.concat(F.lit("Structural Risk: "), tier, F.lit(" (score "), fixed_half_up(score, 4), F.lit(")"))


def status_line(score: Column, tier: Column) -> Column:
    return F.concat(fixed_half_up(score, 2), F.lit(" ["), tier, F.lit("]"))


def status_detail(score: Column, tier: Column, weights: list[Column], findings: Column, functions: Column) -> Column:
    shares = [F.concat(F.lit(f"{name}="), fixed_half_up(w, 2)) for name, w in zip("AVS", weights, strict=True)]
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Score: "), fixed_half_up(score, 4)),
        F.concat(F.lit("Tier: "), tier),
        F.concat(F.lit("Weights: "), F.concat_ws(" ", *shares)),
        F.concat(F.lit("Findings: "), findings.cast("string")),
        F.concat(F.lit("Functions: "), functions.cast("string")),
    )


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n != 1, F.lit("s")).otherwise(F.lit("")))


def capitalised(status: Column) -> Column:
    """First letter upper-case, the rest as it is."""
    return F.concat(F.upper(F.substring(status, 1, 1)), F.substring(status, 2, 2_147_483_647))


def name_or_login(name: Column, login: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), login)


def contains_text(query: str, name: Column, description: Column) -> Column:
    """Case-insensitive search in name or description; a null description never matches."""
    wanted = F.lit(query.lower())
    return F.lower(name).contains(wanted) | F.coalesce(F.lower(description).contains(wanted), F.lit(False))


def utc_iso(moment: Column) -> Column:
    """ISO form of a UTC moment."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
