"""Problems: what is wrong with a request or a query, as clients get to see it."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

#: Begins a problem in the message of an error that an executor raises.
MARK = "marlstone-problem:"


class Errors:
    """What ``error`` says, by kind of problem."""

    ARGUMENTS = "Invalid arguments"
    ARGUMENT_COUNT = "Invalid number of arguments"
    TYPES = "Types don't match"
    TABLE = "Table not found"
    COLUMN = "Column not found"
    TABLES = "Multiple tables"
    WHERE = "Invalid where clause type"
    ORDER_BY = "Invalid order by clause"
    LIMIT = "Invalid limit clause"
    DIVISION = "Division by zero"
    UNIMPLEMENTED = "Unimplemented"
    INPUT_FILE = "Failed to find input file"
    DESTINATION_TABLE = "Undefined table name"
    DESTINATION_COLUMN = "Destination column error"
    INT64 = "Failed to parse INT64"
    CSV = "Invalid CSV file"
    SCHEMA = "Error validating schema"
    UNEXPECTED = "Unexpected error"


@dataclass(frozen=True)
class Problem:
    error: str
    context: str | None = None

    def to_json(self) -> dict:
        return {"error": self.error} | ({} if self.context is None else {"context": self.context})


class ProblemsError(Exception):
    """A query failed for reasons that its author can see."""

    def __init__(self, *problems: Problem):
        super().__init__("; ".join(p.error for p in problems))
        self.problems = list(problems)


class DecodeError(Exception):
    """JSON that isn't what it should be."""


def found_in(error: BaseException) -> list[Problem]:
    """The problems that an exception tells of; an unforeseen one becomes one problem."""
    if isinstance(error, ProblemsError):
        return error.problems
    text = str(error)
    if (at := text.find(MARK)) >= 0:
        try:
            told, _ = json.JSONDecoder().raw_decode(text[at + len(MARK) :])
            return [Problem(told["error"], told.get("context"))]
        except ValueError:
            pass
    name = type(error).__name__
    return [Problem(f"{Errors.UNEXPECTED} {name}: {re.sub(r'\s+', ' ', text)[:300]}")]
