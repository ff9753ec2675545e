"""Exchange vocabulary: packed time, session phase, side, board, clock grid."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowmill.functions.scalars import col, recode, zero_fill

# Fixed values of the published event schema.
PRICE_SCALE = 10_000.0
EVENT_TYPES = ("ADD", "CANCEL", "EXEC", "SNAP", "STATUS", "UNKNOWN")
SIDES = ("B", "S", "N")
SESSIONS = (
    "PRE_OPEN", "OPEN_CALL", "COOLING", "CONT_AM", "LUNCH", "CONT_PM",
    "CLOSE_CALL", "AFTER_CLOSE", "HALT", "UNKNOWN",
)
EVENT_SOURCES = ("ORDER", "TRADE", "SNAPSHOT", "QUEUE", "DERIVED")
ORDER_TYPES = ("LIMIT", "MARKET", "BEST", "CANCEL", "UNKNOWN")
BOARDS = ("MAIN", "STAR", "CHINEXT", "SME", "BSE", "UNKNOWN")
DOMAINS = {
    "evt_type": EVENT_TYPES, "side": SIDES, "session": SESSIONS, "event_source": EVENT_SOURCES, "order_type": ORDER_TYPES, "board": BOARDS,
}
EVENT_TYPE_MAP = {"ADD": "ADD", "CANCEL": "CANCEL", "TRADE": "EXEC"}
SIDE_MAP = {"BUY": "B", "SELL": "S", "UNKNOWN": "N"}
SESSION_MAP = {
    "OPEN_AUCTION": "OPEN_CALL",
    "CONTINUOUS_AM": "CONT_AM",
    "MIDDAY_BREAK": "LUNCH",
    "CONTINUOUS_PM": "CONT_PM",
    "CLOSE_AUCTION": "CLOSE_CALL",
}
MINUTE_MS = 60_000
OPEN_CALL_START = (9 * 60 + 15) * MINUTE_MS
AM_START = (9 * 60 + 30) * MINUTE_MS
AM_END = (11 * 60 + 30) * MINUTE_MS
PM_START = 13 * 60 * MINUTE_MS
PM_AUCTION = (14 * 60 + 57) * MINUTE_MS
PM_END = 15 * 60 * MINUTE_MS
CONTINUOUS_SESSIONS = ((AM_START, AM_END), (PM_START, PM_AUCTION))
CONTINUOUS_SECONDS = sum(end - start for start, end in CONTINUOUS_SESSIONS) / 1000.0


def packed_time(ts: str | Column) -> Column:
    """Timestamp to the packed integer ``HHMMSSmmm``."""
    return F.date_format(col(ts), "HHmmssSSS").cast("long")


def packed_to_ms(c: str | Column) -> Column:
    """Packed ``HHMMSSmmm`` to milliseconds since midnight."""
    t = col(c).cast("long")
    secs = F.expr("0L")
    for divisor, unit in ((10_000_000, 3600), (100_000, 60), (1000, 1)):
        secs = secs + F.floor(t / divisor).cast("long") % 100 * unit
    return (secs * 1000 + t % 1000).cast("long")


def packed_time_valid(c: str | Column) -> Column:
    t = col(c).cast("long")
    hh, mm, ss = (F.floor(t / d).cast("long") % 100 for d in (10_000_000, 100_000, 1000))
    return F.coalesce((t >= 0) & (hh <= 23) & (mm <= 59) & (ss <= 59), F.lit(False))


def time_text(day: str | Column, packed: str | Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS.mmm`` from a day string and a packed time."""
    digits = F.lpad(col(packed).cast("string"), 9, "0")
    clock = F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2))
    return F.concat(col(day), F.lit(" "), clock, F.lit("."), F.substring(digits, 7, 3))


def session_phase(packed: str | Column) -> Column:
    # Upper bounds of each phase in packed time.
    bounds = (
        (93_000_000, "OPEN_AUCTION"),
        (113_000_000, "CONTINUOUS_AM"),
        (130_000_000, "MIDDAY_BREAK"),
        (145_700_000, "CONTINUOUS_PM"),
    )
    t = col(packed)
    out = F.when(t < bounds[0][0], bounds[0][1])
    for bound, name in bounds[1:]:
        out = out.when(t < bound, name)
    return out.otherwise("CLOSE_AUCTION")


def message_type(row_type: str | Column, trade_type: str | Column, order_type: str | Column) -> Column:
    """Trade rows are CANCEL when flagged ``C``; order rows are CANCEL when flagged ``D``."""
    is_trade = col(row_type) == "T"
    cancelled = (is_trade & (col(trade_type) == "C")) | (~is_trade & (col(order_type) == "D"))
    return F.when(cancelled, "CANCEL").when(is_trade, "TRADE").otherwise("ADD")


def side_name(flag: str | Column) -> Column:
    return recode(flag, {"B": "BUY", "b'B'": "BUY", "S": "SELL", "b'S'": "SELL"}, "UNKNOWN")


def exchange_code(market: str | Column) -> Column:
    return F.when(F.upper(col(market)) == "SH", "XSHG").otherwise("XSHE")


def board_name(security: str | Column, market: str | Column) -> Column:
    """Trading board from the six-digit code; the two markets share one number space."""
    # Code prefixes per board.
    star, main_sh = ("688",), ("60",)
    chinext, sme, main_sz = ("300", "301"), ("002", "003"), ("000", "001")
    bse2, bse3 = ("43", "83", "87", "88", "92"), ("920",)
    code = zero_fill(security)
    p2, p3 = F.substring(code, 1, 2), F.substring(code, 1, 3)
    sh = F.when(p3.isin(*star), "STAR").when(p2.isin(*main_sh), "MAIN")
    sz = (
        F.when(p3.isin(*chinext), "CHINEXT")
        .when(p3.isin(*sme), "SME")
        .when(p3.isin(*main_sz), "MAIN")
        .when(p2.isin(*bse2) | p3.isin(*bse3), "BSE")
    )
    known = F.when(F.upper(col(market)) == "SH", sh).otherwise(sz)
    return F.coalesce(known, F.lit("UNKNOWN"))


def order_kind(event_type: str | Column) -> Column:
    return recode(event_type, {"CANCEL": "CANCEL", "TRADE": "UNKNOWN"}, "LIMIT")


def clock_interval(ms: str | Column, minutes: int = 5, include_open_call: bool = True) -> Column:
    """Sequential interval id that skips the lunch break; -1 outside trading hours.

    The boundary instants 11:30 and 15:00 belong to the last bucket of their session.
    """
    if minutes < 1 or 120 % minutes:
        raise ValueError("a session of 120 minutes is not a whole number of such intervals")
    t = col(ms).cast("long")
    width, per_session = minutes * MINUTE_MS, 120 // minutes
    base = 1 if include_open_call else 0

    def bucket(start: int, offset: int) -> Column:
        return F.least(F.floor((t - start) / width), F.lit(per_session - 1)) + offset

    out = F.when((t >= AM_START) & (t <= AM_END), bucket(AM_START, base))
    out = out.when((t >= PM_START) & (t <= PM_END), bucket(PM_START, base + per_session))
    if include_open_call:
        out = out.when((t >= OPEN_CALL_START) & (t < AM_START), F.lit(0))
    return out.otherwise(F.lit(-1)).cast("int")


def session_end(ms: str | Column) -> Column:
    """End of the continuous session containing the time; null outside both sessions."""
    t = col(ms)
    out = None
    for start, end in CONTINUOUS_SESSIONS:
        hit = (t >= start) & (t < end)
        out = F.when(hit, F.lit(end)) if out is None else out.when(hit, F.lit(end))
    return out.cast("long")
