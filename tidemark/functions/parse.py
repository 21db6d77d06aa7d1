"""Text lines ``event_ts,id,content`` to typed events and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_SPREAD = 1001

VALID = "_line.parts = 3 and _line.event_ts is not null and _line.log_id is not null"


# The characters that pad lines, blanks of all scripts included.
BLANKS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(value: str) -> str:
    """``value`` without blanks at its ends; trim() alone removes plain ones only."""
    listed = "".join(f"\\u{ord(c):04x}" for c in BLANKS)
    return f"trim(BOTH '{listed}' FROM {value})"


def _fields(lines: DataFrame, value: str, id_type: str) -> DataFrame:
    """``_line``, one struct of all that a line holds, made once for each line.

    The struct comes out of a generator of one row: the planner copies expressions of a
    projection into the filters and projections above it, but not a generator's.
    """
    typed = f"""transform(array(split({strip(value)}, ',', 3)), p -> struct(
        size(p) as parts, try_cast(get(p, 0) as bigint) as event_ts, try_cast(get(p, 1) as {id_type}) as log_id, get(p, 2) as content))"""
    rows = lines.selectExpr("*", f"explode({typed}) as _line")
    return rows.selectExpr("*", "_line.event_ts as event_ts", "_line.log_id as log_id", "_line.content as content")


def typed_lines(lines: DataFrame, value: str = "value", id_type: str = "bigint") -> DataFrame:
    """All lines, with null fields where the line is malformed.

    For scans that deal raw lines to lanes, where bad lines take their turn too.
    """
    rows = _fields(lines, value, id_type).withColumn("_valid", F.expr(VALID))
    fields = {c: F.expr(f"if(_valid, {c}, null)") for c in ("event_ts", "log_id", "content")}
    return rows.withColumns(fields).drop("_line", "_valid", value)


def parse_lines(lines: DataFrame, value: str = "value", id_type: str = "bigint") -> DataFrame:
    """Typed events; lines with missing fields or bad integers are left out.

    Commas after the second one stay in ``content``. Other columns pass through.
    With ``id_type="int"`` ids of 2**31 and above are bad, as in the original job.
    """
    return _fields(lines, value, id_type).where(VALID).drop("_line", value)


def parse_rejects(lines: DataFrame, value: str = "value", id_type: str = "bigint") -> DataFrame:
    """The lines ``parse_lines`` leaves out, with the reason."""
    reason = """case when _line.parts < 3 then 'missing field'
                     when event_ts is null then 'bad event_ts' else 'bad log_id' end"""
    rows = _fields(lines, value, id_type).where(f"not ({VALID})").withColumn("reason", F.expr(reason))
    return rows.drop("_line", "event_ts", "log_id", "content")


def lane_of(log_id: str, lanes: int) -> str:
    return f"pmod(bigint({log_id}), {lanes})"


def lane_key(log_id: str, lanes: int) -> str:
    """Grouping key of an event: its id modulo the lane count, spread out."""
    return f"({lane_of(log_id, lanes)} * {KEY_SPREAD})"


def format_line(event_ts: str, log_id: str, content: str) -> str:
    return f"concat_ws(',', string({event_ts}), string({log_id}), {content})"


def offset_to_epoch_ms(base_s: str, offset_s: str) -> str:
    """Seconds since a base time to epoch milliseconds, truncated."""
    return f"bigint(({base_s} + {offset_s}) * 1000)"
