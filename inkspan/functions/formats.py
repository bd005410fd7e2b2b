"""One reader and writer per format, and a place to add more: detection and parsing of DataFrames go through it."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column

from .columns import MARKERS
from .records import GROUPS, Model, model, record
from .writeback import write_model


class FormatAdapter(Protocol):
    """What a format offers. It is sent to executors with each job that parses, as it is when that job is planned; its module
    must be one that they can import, or it is defined in a session or a function, and goes with the job."""

    def parse_row(self, raw: str, groups: tuple[str, ...]) -> dict:
        """The columns of these groups (see records.GROUPS); what is left out is null. StructureError or ValueError if the
        record can't be read."""
        ...

    def matches(self, raw: Column) -> Column | None:
        """Whether records are of this format, before the built-in detection is asked; None leaves it to that."""
        ...


class BuiltIn:
    def __init__(self, form: str):
        self.form = form

    def matches(self, raw: Column) -> Column | None:
        return None

    def parse_row(self, raw: str, groups: tuple[str, ...] = tuple(GROUPS)) -> dict:
        return record(model(raw, self.form, groups), groups)

    def parse_document(self, raw: str) -> Model:
        return model(raw, self.form)

    def write_document(self, document: Model) -> str:
        return write_model(document)


#: By name of the format.
FORMATS: dict[str, FormatAdapter] = {name: BuiltIn(name) for name in dict.fromkeys([*(m[0] for m in MARKERS), "UsptoGrantApsGreenBook"])}
_BUILT_IN = frozenset(FORMATS)


def add_format(name: str, adapter: FormatAdapter) -> None:
    """From now on, jobs that are planned know this format, too; a built-in one can't be replaced."""
    if name in _BUILT_IN:
        raise ValueError(f"built-in format: {name}")
    FORMATS[name] = adapter


def remove_format(name: str) -> None:
    if name in _BUILT_IN:
        raise ValueError(f"built-in format: {name}")
    FORMATS.pop(name, None)
