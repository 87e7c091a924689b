"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: ISO text with an offset such as +0000, +00:00 or Z.
TRANSACTION_TIME = "yyyy-MM-dd'T'HH:mm:ss[XXX][XX]"

ColumnOrName = Column | str
Moment = Column | datetime | str | None


def _column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def transaction_time(text: ColumnOrName, lenient: bool = False) -> Column:
    """Timestamp of an ISO text with offset; malformed text raises unless ``lenient``."""
    parse = F.try_to_timestamp if lenient else F.to_timestamp
    pattern = F.lit(TRANSACTION_TIME) if lenient else TRANSACTION_TIME
    return parse(_column(text), pattern)


def moment(value: Moment) -> Column:
    """A moment given as ISO text, time or column."""
    if isinstance(value, str):
        return transaction_time(F.lit(value))
    return F.lit(value)


def in_window(time: ColumnOrName, start: Moment = None, end: Moment = None, closed: str = "both") -> Column:
    """Whether a time lies between two optional bounds.

    ``closed="both"`` keeps a time equal to a bound, ``closed="neither"`` drops it.
    """
    if closed not in ("both", "neither"):
        raise ValueError(f"closed must be 'both' or 'neither', not {closed!r}")
    time = _column(time)
    keep = F.lit(True)
    if start is not None:
        keep = keep & ((time >= moment(start)) if closed == "both" else (time > moment(start)))
    if end is not None:
        keep = keep & ((time <= moment(end)) if closed == "both" else (time < moment(end)))
    return keep


def is_confirmed(confirmations: ColumnOrName = "confirmations") -> Column:
    return _column(confirmations) > 0


def is_coinbase(flag: ColumnOrName = "is_coinbase") -> Column:
    return _column(flag)


def is_usable(address: ColumnOrName) -> Column:
    """Neither missing nor the empty text."""
    address = _column(address)
    return address.isNotNull() & (address != "")


def low_end(left: ColumnOrName, right: ColumnOrName) -> Column:
    return F.least(_column(left), _column(right))


def high_end(left: ColumnOrName, right: ColumnOrName) -> Column:
    return F.greatest(_column(left), _column(right))
