"""Loading delimited lines, and telling why the others fail: a minimum-cost error parse.

A parse reads a line with an automaton over ordinary text, quotes and delimiters. Edits insert or
delete a quote or a delimiter; the cheapest edit sequence that yields well-quoted fields in the right
number is found by dynamic programming, quote edits weighing more than any number of delimiter edits.
A line that needs no edit and whose values fit their columns loads. Otherwise the edits are the
reason: a quote edit means 'quoting', delimiter edits alone 'columns'; a zero-cost line with a wrong
value is 'invalid'. Most lines are plainly right, which one regular expression a feed decides in the JVM:
only the others, and very long ones, reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column as SqlColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE_COST = 1_000_000
JVM_CHARS = 2_000  # the JVM's regular expressions nest with the text; longer lines take the same steps in Python
START, PLAIN, QUOTED, CLOSED = range(4)
KINDS = ("quote inserted", "quote deleted", "delimiter inserted", "delimiter deleted")


@dataclass(frozen=True)
class Column:
    """kind: 'any', 'number' (whole, within low..high), 'code' (one of codes) or 'word' (one of codes
    whatever the case)."""

    name: str
    kind: str = "any"
    low: int = 0
    high: int = 0
    codes: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Feed:
    """missing: texts that stand for no value and fit every column."""

    sep: str
    columns: tuple[Column, ...]
    missing: frozenset[str] = frozenset({"", "NA", "-99"})


def splitter(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """(whole line, one field); possessive, so that no text makes them backtrack."""
    s = re.escape(sep)
    one = rf'(?:"(?:[^"]++|"")*+"|[^"{s}]*+)'
    return re.compile(rf"{one}(?:{s}{one})*+"), re.compile(rf"({one})(?:{s}|\Z)")


def zero_cost_fields(line: str, sep: str, patterns: tuple[re.Pattern, re.Pattern]) -> list[str] | None:
    """The fields, unquoted; None where the quoting is broken."""
    if '"' not in line:
        return line.split(sep)
    whole, one = patterns
    if not whole.fullmatch(line):
        return None
    out, at = [], 0
    while True:
        m = one.match(line, at)
        text = m.group(1)
        out.append(text[1:-1].replace('""', '"') if text[:1] == '"' else text)
        if m.end() == m.end(1):
            return out
        at = m.end()


def cheapest_edits(line: str, sep: str, fields: int) -> tuple[int, int, int, int]:
    """How many quotes are inserted, deleted and delimiters inserted, deleted by the cheapest edits
    that make the line ``fields`` well-quoted fields. O(symbols x fields); runs of ordinary text are
    one symbol. A deleted delimiter joins two fields, each with the quotes it has, so that delimiters
    alone repair every line whose quoting is right, and no other."""
    inf = np.int64(1) << 60
    cost = np.full((4, fields), inf)
    ops = np.zeros((4, fields, 4), dtype=np.int64)
    cost[START, 0] = 0
    prices = (QUOTE_COST, QUOTE_COST, 1, 1)

    def relax(cost, ops, to, frm_cost, frm_ops, kind=None):
        c = frm_cost + (prices[kind] if kind is not None else 0)
        better = c < cost[to]
        if better.any():
            cost[to][better] = c[better]
            o = frm_ops[better].copy()
            if kind is not None:
                o[:, kind] += 1
            ops[to][better] = o

    def insert_quotes(cost, ops):
        relax(cost, ops, QUOTED, cost[START], ops[START], 0)
        relax(cost, ops, QUOTED, cost[CLOSED], ops[CLOSED], 0)
        relax(cost, ops, CLOSED, cost[QUOTED], ops[QUOTED], 0)

    def shifted(c, o):
        return np.concatenate([[inf], c[:-1]]), np.concatenate([np.zeros((1, 4), dtype=np.int64), o[:-1]])

    for s in re.findall(rf'"|{re.escape(sep)}|[^"{re.escape(sep)}]+', line):
        insert_quotes(cost, ops)
        c2, o2 = np.full((4, fields), inf), np.zeros((4, fields, 4), dtype=np.int64)
        if s == '"':
            relax(c2, o2, QUOTED, cost[START], ops[START])
            relax(c2, o2, CLOSED, cost[QUOTED], ops[QUOTED])
            relax(c2, o2, QUOTED, cost[CLOSED], ops[CLOSED])
            for k in range(4):
                relax(c2, o2, k, cost[k], ops[k], 1)
        elif s == sep:
            relax(c2, o2, QUOTED, cost[QUOTED], ops[QUOTED])
            for k in (START, PLAIN, CLOSED):
                relax(c2, o2, START, *shifted(cost[k], ops[k]))
                relax(c2, o2, START, cost[k], ops[k], 3)  # what follows is read as before, in the same field
        else:
            relax(c2, o2, PLAIN, cost[START], ops[START])
            relax(c2, o2, PLAIN, cost[PLAIN], ops[PLAIN])
            relax(c2, o2, QUOTED, cost[QUOTED], ops[QUOTED])
        cost, ops = c2, o2
    insert_quotes(cost, ops)
    best, how = inf, (0, 0, 0, 0)
    for k in (START, PLAIN, CLOSED):
        for f in range(fields):
            lacking = fields - 1 - f
            if cost[k, f] + lacking < best:
                best = cost[k, f] + lacking
                how = (*map(int, ops[k, f, :2]), int(ops[k, f, 2]) + lacking, int(ops[k, f, 3]))
    return how


LINES_AT_ONCE, SYMBOLS = 256, 2_000  # lines whose edits are found together, each of so many symbols at most


def cheapest_edits_of(lines: Sequence[str], sep: str, fields: int) -> list[tuple[int, int, int, int]]:
    """``cheapest_edits`` of every line: the same table for many lines at once. Kinds of symbols: 0 text,
    1 quote, 2 delimiter, 3 past the line's end."""
    out: list = [None] * len(lines)
    cut = re.compile(rf'"|{re.escape(sep)}|[^"{re.escape(sep)}]+')
    kinds = {'"': 1, sep: 2}
    symbols = [[kinds.get(x, 0) for x in cut.findall(line)] for line in lines]
    short = sorted((i for i in range(len(lines)) if len(symbols[i]) <= SYMBOLS), key=lambda i: len(symbols[i]))
    for i in set(range(len(lines))) - set(short):
        out[i] = cheapest_edits(lines[i], sep, fields)
    for a in range(0, len(short), LINES_AT_ONCE):
        some = short[a : a + LINES_AT_ONCE]
        table = np.full((len(some), max(len(symbols[i]) for i in some) or 1), 3, dtype=np.int8)
        for k, i in enumerate(some):
            table[k, : len(symbols[i])] = symbols[i]
        for i, how in zip(some, _edit_tables(table, fields)):
            out[i] = how
    return out


def _edit_tables(table: np.ndarray, fields: int) -> list[tuple[int, int, int, int]]:
    """States x lines x fields, each with its cost and its four numbers of edits, packed."""
    n = len(table)
    inf = np.int64(1) << 60
    one = [np.int64(1) << (15 * k) for k in range(4)]
    price = (QUOTE_COST, QUOTE_COST, 1, 1)
    cost, ops = np.full((4, n, fields), inf), np.zeros((4, n, fields), dtype=np.int64)
    cost[START, :, 0] = 0

    def relax(to: int, c: np.ndarray, o: np.ndarray, cost: np.ndarray, ops: np.ndarray, kind: int | None = None, where: np.ndarray | None = None) -> None:
        if kind is not None:
            c, o = c + price[kind], o + one[kind]
        better = c < cost[to]
        if where is not None:
            better &= where
        np.copyto(cost[to], c, where=better)
        np.copyto(ops[to], o, where=better)

    def insert_quotes(cost: np.ndarray, ops: np.ndarray) -> None:
        relax(QUOTED, cost[START], ops[START], cost, ops, 0)
        relax(QUOTED, cost[CLOSED], ops[CLOSED], cost, ops, 0)
        relax(CLOSED, cost[QUOTED], ops[QUOTED], cost, ops, 0)

    def shifted(c: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.full((n, 1), inf), c[:, :-1]], axis=1), np.concatenate([np.zeros((n, 1), dtype=np.int64), o[:, :-1]], axis=1)

    for t in range(table.shape[1]):
        text, quote, delimiter, over = ((table[:, t] == k)[:, None] for k in range(4))
        before, before_ops = cost.copy(), ops.copy()
        insert_quotes(cost, ops)
        c2, o2 = np.full_like(cost, inf), np.zeros_like(ops)
        if quote.any():
            relax(QUOTED, cost[START], ops[START], c2, o2, None, quote)
            relax(CLOSED, cost[QUOTED], ops[QUOTED], c2, o2, None, quote)
            relax(QUOTED, cost[CLOSED], ops[CLOSED], c2, o2, None, quote)
            for k in range(4):
                relax(k, cost[k], ops[k], c2, o2, 1, quote)
        if delimiter.any():
            relax(QUOTED, cost[QUOTED], ops[QUOTED], c2, o2, None, delimiter)
            for k in (START, PLAIN, CLOSED):
                relax(START, *shifted(cost[k], ops[k]), c2, o2, None, delimiter)
                relax(START, cost[k], ops[k], c2, o2, 3, delimiter)
        if text.any():
            relax(PLAIN, cost[START], ops[START], c2, o2, None, text)
            relax(PLAIN, cost[PLAIN], ops[PLAIN], c2, o2, None, text)
            relax(QUOTED, cost[QUOTED], ops[QUOTED], c2, o2, None, text)
        cost, ops = np.where(over, before, c2), np.where(over, before_ops, o2)
    insert_quotes(cost, ops)
    lacking = np.arange(fields - 1, -1, -1)
    ends = np.stack([cost[k] + lacking for k in (START, PLAIN, CLOSED)], axis=1).reshape(n, -1)
    best = ends.argmin(1)
    out = []
    for i, b in enumerate(best.tolist()):
        k, f = (START, PLAIN, CLOSED)[b // fields], b % fields
        packed = int(ops[k, i, f])
        qi, qd, di, dd = ((packed >> (15 * j)) & 0x7FFF for j in range(4))
        out.append((qi, qd, di + fields - 1 - f, dd))
    return out


_WHOLE = re.compile(r"-?[0-9]+")


def wrong_value(value: str, column: Column, missing: frozenset[str]) -> bool:
    if column.kind == "any":
        return False
    v = value.strip()
    if v in missing:
        return False
    if column.kind == "number":
        return not (_WHOLE.fullmatch(v) and len(v) < 19 and column.low <= int(v) <= column.high)
    return (v.lower() if column.kind == "word" else v) not in column.codes


def judge_all(lines: Sequence[str | None], feed: Feed, patterns) -> list[tuple[str | None, str | None, list[str] | None]]:
    """(reason or None, detail, fields) of each line."""
    out: list = [None] * len(lines)
    todo = []
    for i, line in enumerate(lines):
        line = line or ""
        line = line[:-1] if line.endswith("\r") else line
        values = zero_cost_fields(line, feed.sep, patterns)
        if values is None or len(values) != len(feed.columns):
            todo.append((i, line))
            continue
        wrong = next((f"{c.name}: {v}" for v, c in zip(values, feed.columns) if wrong_value(v, c, feed.missing)), None)
        out[i] = ("invalid", wrong, None) if wrong is not None else (None, None, values)
    for (i, _), edits in zip(todo, cheapest_edits_of([line for _, line in todo], feed.sep, len(feed.columns)) if todo else ()):
        said = ", ".join(f"{n} x {k}" for n, k in zip(edits, KINDS) if n)
        out[i] = ("quoting" if edits[0] + edits[1] else "columns"), said, None
    return out


def judge(line: str | None, feed: Feed, patterns) -> tuple[str | None, str | None, list[str] | None]:
    return judge_all([line], feed, patterns)[0]


def _surely_right(feed: Feed) -> str:
    """A pattern of lines that load: plainly written values, quoted or not. It is narrower than the rules;
    what it does not match is read value by value, in Python."""
    s = re.escape(feed.sep)
    missing = [re.escape(m) for m in sorted(feed.missing) if '"' not in m and feed.sep not in m]
    columns = []
    for c in feed.columns:
        if c.kind == "any":
            columns.append(rf'(?:"[^"]*"|[^"{s}]*)')
            continue
        listed = [str(v) for v in range(c.low, min(c.high, c.low + 200) + 1)] if c.kind == "number" else sorted(c.codes)[:200]
        plain = "|".join([re.escape(v) for v in listed if '"' not in v and feed.sep not in v] + missing) or "(?!)"
        one = rf"[ \t]*(?{'i' if c.kind == 'word' else ''}:{plain})[ \t]*"
        columns.append(rf'(?:{one}|"{one}")')
    return rf"\A{s.join(columns)}\z"


def _plain_fields(sep: str) -> SqlColumn:
    """The unquoted fields of column ``_line``, in which no quote is doubled."""
    line, s = F.col("_line"), re.escape(sep)
    cut = F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(rf'("[^"]*"|[^"{s}]*){s}'), F.lit(1))
    return F.when(~F.contains(line, F.lit('"')), F.split(line, s, -1)).otherwise(F.transform(cut, lambda f: F.btrim(f, F.lit('"'))))


def parse_lines(lines: DataFrame, feeds: dict[str, Feed]) -> DataFrame:
    """(line_id, feed, reason, detail, fields) for every line but headers (line_no 1).

    reason is NULL for a loaded row, whose ``fields`` are its values in column order; of a rejected
    line, fields is NULL. A NULL line reads as an empty one; a feed that is not known (or NULL) is
    'invalid' with that detail; repeated lines come out repeatedly. Row-parallel: no shuffle.
    """
    patterns = {name: splitter(f.sep) for name, f in feeds.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list = [("invalid", "feed is not known", None)] * len(b)
            for name, feed in feeds.items():
                mine = np.flatnonzero((b["feed"] == name).to_numpy(dtype=bool, na_value=False))
                for i, r in zip(mine, judge_all(b["line"].iloc[mine].tolist(), feed, patterns[name])):
                    out[i] = r
            reason, detail, fields = zip(*out) if out else ((), (), ())
            yield pd.DataFrame(
                {"line_id": b["line_id"], "feed": b["feed"], "reason": list(reason), "detail": list(detail), "fields": list(fields)}
            )

    schema = "line_id bigint, feed string, reason string, detail string, fields array<string>"
    data = lines.filter(~F.coalesce(F.col("line_no") == 1, F.lit(False))).select("line_id", "feed", "line")
    if not feeds:
        return data.mapInPandas(run, schema)
    text = F.coalesce("line", F.lit(""))
    data = data.withColumn("_line", F.when(text.endswith("\r"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text))
    sure, cut = F.lit(False), None
    for name, f in feeds.items():
        mine = F.col("feed") == name
        sure = sure | (mine & (F.length("_line") <= JVM_CHARS) & F.col("_line").rlike(_surely_right(f)))
        cut = (F if cut is None else cut).when(mine, _plain_fields(f.sep))
    sure = F.coalesce(sure, F.lit(False))
    nothing = F.lit(None).cast("string")
    plain = data.filter(sure).select("line_id", "feed", nothing.alias("reason"), nothing.alias("detail"), cut.alias("fields"))
    return plain.unionByName(data.filter(~sure).select("line_id", "feed", "line").mapInPandas(run, schema))
