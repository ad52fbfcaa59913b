"""Which kind of text a row holds: an ordered cascade that users can extend."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from ..functions.text import BOUNDARY, col, count_of, lines, nonblank, nth, valid_json, word

# --- fixed values: detector patterns ------------------------------------------
COMPILER_ERROR = r"error TS\d+:"
TEST_RUN = r"(?i)Tests:.*total|PASS\s|FAIL\s|test suites"
BUILD = word("Compiling|Bundling|Route|Bundle size|webpack|vite|esbuild|Building")
COMMIT_LOG = r"(?m)^commit [a-f0-9]{40}|^[a-f0-9]{7,}\s"
HTTP_METHOD = word("GET|POST|PUT|DELETE|PATCH", ignore_case=False)
HTTP_STATUS = word(r"[2-5]\d{2}", ignore_case=False)
ERROR_TEXT = r"(?m)^(\w*Error|Traceback|FATAL|PANIC|Exception)|^\s+at\s+.+\(.+:\d+:\d+\)|File \".+\", line \d+"
HTML = r"(?i)<html|<head|<body|<!DOCTYPE"
CODE = [r"function\s+\w+", r"class\s+\w+", r"export\s+", r"import\s+", r"const\s+\w+\s*=",
        r"def\s+\w+", r"class\s+\w+", r"(?m)^import\s+", r"(?m)^from\s+\w+"]
ACCESS_LINE = (r'^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\s.*\[.+\]\s"(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(\S+)\s+HTTP/[\d.]+"'
               r"\s+(\d{3})\s+(\d+)")
LOG_LINE = r"\d{4}-\d{2}-\d{2}|\d{2}:\d{2}:\d{2}|" + word("INFO|WARN|ERROR|DEBUG|TRACE|FATAL", ignore_case=False)
UNPRINTABLE = r"[^\t\n\r -~]"


def _is_csv(c: Column) -> Column:
    counts = F.transform(F.slice(nonblank(lines(c)), 1, 10), lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))
    first = nth(counts, 0)
    return (F.size(counts) >= 5) & (first > 0) & (F.size(F.filter(counts, lambda n: n == first)) >= 5)


def _is_log(c: Column) -> Column:
    ls = nonblank(lines(c))
    sample = F.slice(ls, 1, 20)
    access = F.size(F.filter(sample, lambda x: x.rlike(ACCESS_LINE))) / F.greatest(F.size(sample), F.lit(1)) >= 0.5
    logged = F.size(F.filter(ls, lambda x: x.rlike(LOG_LINE))) / F.greatest(F.size(ls), F.lit(1)) >= 0.3
    return (F.size(ls) >= 10) & (access | logged)


def _is_json(c: Column) -> Column:
    return c.rlike(r"^\s*[{\[]") & valid_json(c)


def _is_code(c: Column) -> Column:
    hits = sum((F.when(c.rlike(p), 1).otherwise(0) for p in CODE), F.lit(0))
    return (F.size(lines(c)) >= 20) & (hits >= 2)


def _is_unprintable(c: Column) -> Column:
    head = F.substring(c, 1, 512)
    return (F.length(head) > 0) & (F.regexp_count(head, F.lit(UNPRINTABLE)) / F.greatest(F.length(head), F.lit(1)) > 0.1)


@dataclass
class Kind:
    name: str
    priority: int
    detect: Callable[[Column], Column]
    apply: Callable[[Column], Column] | None = None


@dataclass
class Kinds:
    """Detectors in order of priority; below 100 runs before the built-in ones, above 900 after."""

    kinds: list[Kind] = field(default_factory=list)

    def register(self, name, priority, detect, apply=None) -> "Kinds":
        return Kinds(sorted([*self.kinds, Kind(name, priority, detect, apply)], key=lambda k: k.priority))

    def classify(self, content) -> Column:
        """Name of the first kind that detects the text, else 'text'."""
        c = col(content)
        return F.coalesce(*[F.when(k.detect(c), k.name) for k in self.kinds], F.lit("text"))

    def summarise(self, content) -> Column:
        """The text through the ``apply`` of its kind; kinds without one leave it whole."""
        c = col(content)
        out = c
        for k in reversed(self.kinds):
            out = F.when(k.detect(c), k.apply(c) if k.apply else c).otherwise(out)
        return out


def builtin() -> Kinds:
    few = lambda c: F.size(nonblank(lines(c))) >= 10
    order = [
        ("typescript-error", lambda c: c.rlike(COMPILER_ERROR)),
        ("test-output", lambda c: c.rlike(TEST_RUN)),
        ("build-output", lambda c: c.rlike(BUILD)),
        ("git-log", lambda c: c.rlike(COMMIT_LOG)),
        ("network", lambda c: few(c) & c.rlike(HTTP_METHOD) & c.rlike(HTTP_STATUS)),
        ("error", lambda c: c.rlike(ERROR_TEXT)),
        ("json", _is_json),
        ("csv", _is_csv),
        ("markdown", lambda c: count_of(c, r"(?m)^#{1,6}\s") >= 2),
        ("html", lambda c: c.rlike(HTML)),
        ("code", _is_code),
        ("log", _is_log),
        ("shell", lambda c: F.size(lines(c)) >= 20),
        ("binary", _is_unprintable),
    ]
    return Kinds([Kind(n, 500, d) for n, d in order])


def content_type(content) -> Column:
    return builtin().classify(content)
