"""Codes of the events of a placement, run ids, and log lines as JSON."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import status as X

#: Codes that logs carry, with the event that each stands for. The set form of the
#: placement has no walk, so those of its single steps (0005 to 0014, 0017, 0018) are never logged.
CODES = {
    "UCPLACE0001": "placement of sequences started",
    "UCPLACE0002": "placement of sequences ended",
    "UCPLACE0003": "placement of a sequence started",
    "UCPLACE0004": "placement of a sequence ended",
    "UCPLACE0005": "k-mers of the query made",
    "UCPLACE0006": "map of the query's k-mers made",
    "UCPLACE0007": "map of the root's k-mers made",
    "UCPLACE0008": "expected coverage",
    "UCPLACE0009": "descent started",
    "UCPLACE0010": "level reached",
    "UCPLACE0011": "clade without enough coverage",
    "UCPLACE0012": "one against rest: set of clades made",
    "UCPLACE0013": "one against rest: counts made",
    "UCPLACE0014": "clades to be judged",
    "UCPLACE0015": "no clade left: maximal resolution reached",
    "UCPLACE0016": "one clade left: identity found",
    "UCPLACE0017": "one clade left, with clades below: next level",
    "UCPLACE0018": "several clades left",
    "UCPLACE0019": "several clades left: inconclusive",
    "UCPLACE00020": "annotations of the model are used",
}
STARTED, ENDED, ANNOTATED = "UCPLACE0001", "UCPLACE0002", "UCPLACE00020"

log = logging.getLogger("cladeframe")


def run_id() -> str:
    """A new random id, without dashes."""
    return uuid.uuid4().hex


def bare(uuid_text: Column) -> Column:
    """A UUID's text without dashes."""
    return F.regexp_replace(uuid_text, "-", "")


def outcome(status: Column) -> Column:
    """The code of the event that ended a placement; null for errors and queries that were never compared."""
    return F.when(status == X.RESOLUTION, "UCPLACE0015").when(status == X.IDENTITY, "UCPLACE0016").when(status == X.INCONCLUSIVE, "UCPLACE0019")


def event(code: str, **fields) -> None:
    log.info(CODES[code], extra={"fields": {"code": code, **fields}})


class JsonLines(logging.Formatter):
    """One JSON object a record: timestamp, level, fields (message, code and others), target."""

    def format(self, record: logging.LogRecord) -> str:
        at = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(record.created)) + f".{record.created % 1 * 1e6:06.0f}Z"
        fields = {"message": record.getMessage(), **getattr(record, "fields", {})}
        if record.exc_info:
            fields["error"] = self.formatException(record.exc_info)
        return json.dumps({"timestamp": at, "level": record.levelname, "fields": fields, "target": record.name}, ensure_ascii=False)


@contextmanager
def job_log(path: Path) -> Iterator[None]:
    """Adds the engine's log lines of the body to a file."""
    handler = logging.FileHandler(path)
    handler.setFormatter(JsonLines())
    level = log.level
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    try:
        yield
    finally:
        log.setLevel(level)
        log.removeHandler(handler)
        handler.close()
