"""What can go wrong in a query."""


class QueryError(Exception):
    """Base of all query errors."""


class ParseError(QueryError):
    """The text isn't a query; ``position`` is where that showed."""

    def __init__(self, message: str, position: int = 0):
        super().__init__(f"{message} at position {position}")
        self.position = position


class UnsupportedExpression(QueryError):
    """A known form that this engine doesn't evaluate."""


class UnknownFunction(QueryError):
    """A function that the language doesn't have."""


class DuplicateSeries(QueryError):
    """Two series of a result have equal labels at one step."""


class ManyToMany(QueryError):
    """The side of a match that must be single isn't."""


class TooManySamples(QueryError):
    """A query would hold more samples than its limit."""


class QueryTimeout(QueryError):
    """A query took longer than its limit; its Spark jobs were cancelled."""


#: Starts of messages that ``raise_error`` carries out of Spark, and what they become.
MARKS = {"PULSEGRID_DUPLICATE": DuplicateSeries, "PULSEGRID_MANY": ManyToMany, "PULSEGRID_PARAM": QueryError, "PULSEGRID_SAMPLES": TooManySamples}


def translated(error: Exception) -> Exception:
    """The query error behind a Spark exception, or the exception itself."""
    text = str(error)
    for mark, kind in MARKS.items():
        if (at := text.find(mark)) >= 0:
            return kind(text[at + len(mark) :].lstrip(": ").split("\n")[0].split(" SQLSTATE")[0])
    return error
