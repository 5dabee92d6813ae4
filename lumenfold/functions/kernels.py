"""Functions no native expression covers, over Arrow batches: NFKC, sequence similarity, longest common subsequence, HTML tables, CSV cells, readings of a table merged."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from heapq import heappop, heappush
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F


def nfkc_words(text: str | None) -> str:
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", text or "").casefold()))


def _over(kind: str, f, *cols):
    """f on every row of the columns, as a pandas UDF made where the plan is built (workers import this module without a session)."""
    if len(cols) == 1:

        def run(a: pd.Series) -> pd.Series:
            return pd.Series([f(x) for x in a], dtype="object" if kind not in ("double", "long") else None)
    else:

        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype="object" if kind not in ("double", "long") else None)

    return F.pandas_udf(run, kind)(*cols)


def normalized_evidence(c):
    return _over("string", nfkc_words, c)


def sequence_ratio_of(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


def sequence_ratio(a, b):
    return _over("double", sequence_ratio_of, a, b)


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """(place in a, place in b, length) of the longest common block, the first in `a` and then in `b` at ties, as difflib finds it.

    Blocks of one length are looked for as equal pieces. A block of some length starts with shorter ones, so lengths are halved upon and
    longer blocks are looked for only where shorter ones are.
    """
    low, high, at, to = 0, min(len(a), len(b)), range(len(a)), range(len(b))
    k = min(4, high)
    while low < high:
        if k * (len(at) + len(to)) > 1 << 24:  # pieces of long texts would take much memory
            return SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b))
        pieces = {b[j : j + k] for j in to if j + k <= len(b)}
        if starts := [i for i in at if a[i : i + k] in pieces]:
            pieces = {a[i : i + k] for i in starts}
            low, at, to = k, starts, [j for j in to if b[j : j + k] in pieces]
        else:
            high = k - 1
        k = min(2 * low, (low + high + 1) // 2) if low else (high + 1) // 2
    return (at[0], b.find(a[at[0] : at[0] + low]), low) if low else (0, 0, 0)


def reached_ratio(a: str, b: str, floor: float, bound: int | None = None) -> float | None:
    """The sequence ratio of two texts if it is `floor` or more, else null.

    Blocks are found as difflib finds them, in the part that may hold the most; what is left of a part holds no more than its longest
    common subsequence, and the search ends when all parts together can't reach the floor. `bound` is that of the whole texts, if known.
    """
    total = len(a) + len(b)
    found, open_ = 0, common_length(a, b) if bound is None else bound
    parts = [(-open_, 0, a, b)]
    n = 0
    while parts:
        if 2.0 * (found + open_) / total < floor:
            return None
        bound, _, x, y = heappop(parts)
        open_ += bound
        i, j, k = longest_block(x, y)
        found += k
        for p, q in ((x[:i], y[:j]), (x[i + k :], y[j + k :])):
            if k and p and q and (most := common_length(p, q)):
                n += 1
                heappush(parts, (-most, n, p, q))
                open_ += most
    ratio = 2.0 * found / total
    return ratio if ratio >= floor else None


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all texts one after another, lengths)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def _shared_letters(asked: list[str], texts: list[str]) -> np.ndarray:
    """How many letters each asked text and each text have in common, by number of occurrences: one row an asked text."""
    letters, lengths = _coded(texts)
    alphabet, code = np.unique(letters, return_inverse=True)
    key, n = np.unique(np.repeat(np.arange(len(texts)), lengths) * len(alphabet) + code, return_counts=True)
    row, code = np.divmod(key, max(len(alphabet), 1))
    out = np.zeros((len(asked), len(texts)), np.int64)
    for i, a in enumerate(asked):
        own, count = np.unique(_coded([a])[0], return_counts=True)
        at = np.minimum(np.searchsorted(alphabet, own), len(alphabet) - 1)
        have = np.zeros(len(alphabet), np.int64)
        have[at] = np.where(alphabet[at] == own, count, 0)
        out[i] = np.bincount(row, np.minimum(n, have[code]), len(texts)).astype(np.int64)
    return out


#: Letters of a text whose subsequences are counted for many texts at once; longer ones are compared one by one.
LETTERS_AT_ONCE = 512


def common_lengths(a: str, texts: list[str]) -> np.ndarray:
    """common_length of `a` and each text: the bits of a row are words of 64, and one operation goes over all texts."""
    if len(a) > LETTERS_AT_ONCE or len(texts) < 8:
        return np.array([common_length(a, t) for t in texts], np.int64)
    letters, lengths = _coded(texts)
    order = np.argsort(-lengths, kind="stable")
    start, width = (np.cumsum(lengths) - lengths)[order], -(-len(a) // 64) or 1
    alphabet, code = np.unique(_coded([a])[0], return_inverse=True)
    masks = np.zeros((width, len(alphabet) + 1), np.uint64)  # the last letter is any other
    np.bitwise_or.at(masks, (np.arange(len(a)) // 64, code), np.uint64(1) << (np.arange(len(a)) % 64).astype(np.uint64))
    at = np.minimum(np.searchsorted(alphabet, letters), len(alphabet) - 1)
    at = np.where(alphabet[at] == letters, at, len(alphabet))
    rows = np.full((width, len(texts)), ~np.uint64(0))
    alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # texts longer than each place
    for place, m in enumerate(alive.tolist()):
        hits, carry = masks[:, at[start[:m] + place]], np.zeros(m, np.uint64)
        for w in range(width):
            row = rows[w, :m]
            hit = row & hits[w]
            added = row + hit
            over = added < hit
            added += carry
            carry = (over | (added < carry)).astype(np.uint64)
            rows[w, :m] = added | (row ^ hit)
    rows[-1] |= ~np.uint64(0) << np.uint64(len(a) % 64) if len(a) % 64 else np.uint64(0)
    out = np.empty(len(texts), np.int64)
    out[order] = (64 - np.bitwise_count(rows).astype(np.int64)).sum(0)
    return out


def best_ratios(batches):
    """Of batches of pairs (evidence_id, q, floor, o, node_id, t), each evidence's greatest sequence ratio of `floor` or more, and its first node.

    Letters in common and then the longest common subsequence bound a ratio; pairs whose bounds are under the best so far are not compared.
    """
    best: dict = {}
    schema = None
    order = lambda x: (-x[0], *((v is not None, v) for v in x[1:]))  # noqa: E731 - nulls first, as Spark has them
    for batch in batches:
        schema = batch.schema
        ids, texts = batch.column("evidence_id").dictionary_encode(), batch.column("t").dictionary_encode()
        floors, places, nodes = (batch.column(c) for c in ("floor", "o", "node_id"))
        which, text = ids.indices.to_numpy(), texts.indices.to_numpy()
        words, (heads, first) = texts.dictionary.to_pylist(), np.unique(which, return_index=True)
        asked = batch.column("q").take(pa.array(first)).to_pylist()
        length = np.array([len(t) for t in words], np.int64)
        shared = _shared_letters(asked, words)
        for e, (q, head) in enumerate(zip(asked, heads, strict=True)):
            key = ids.dictionary[int(head)].as_py()
            floor = max(floors[int(first[e])].as_py(), best[key][0] if key in best else 0.0)
            rows = np.flatnonzero(which == head)
            rows = rows[2.0 * shared[e, text[rows]] / (len(q) + length[text[rows]]) >= floor]
            most = common_lengths(q, [words[i] for i in text[rows].tolist()])
            bound = 2.0 * most / (len(q) + length[text[rows]])
            for i in np.argsort(-bound, kind="stable").tolist():
                if bound[i] < floor:
                    break
                row = int(rows[i])
                ratio = reached_ratio(q, words[text[row]], floor, int(most[i]))
                if ratio is not None:
                    own = (ratio, places[row].as_py(), nodes[row].as_py())
                    if key not in best or order(own) < order(best[key]):
                        best[key] = own
                    floor = ratio
    if best:
        kinds = [schema.field("evidence_id").type, pa.float64(), schema.field("o").type, schema.field("node_id").type]
        columns = zip(*((key, *own) for key, own in best.items()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["evidence_id", "score", "o", "node_id"])


def common_length(a: list[str] | str, b: list[str] | str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: one machine word operation covers a row."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_length(a, b):
    return _over("long", common_length, a, b)


class _Rows(HTMLParser):
    """Rows of cells; a row or line break starts a row, a cell tag a cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = [[""]]

    def handle_starttag(self, tag, attrs):
        if tag in ("tr", "br"):
            self.rows.append([""])
        elif tag in ("td", "th"):
            self.rows[-1].append("")

    def handle_data(self, data):
        self.rows[-1][-1] += " ".join(data.split())


def html_rows(markup: str | None) -> str:
    """Tab-separated rows of an HTML table's non-empty cells; empty rows go."""
    if not markup:
        return ""
    reader = _Rows()
    reader.feed(markup)
    reader.close()
    rows = (("\t".join(cell for cell in row if cell)) for row in reader.rows)
    return "\n".join(row for row in rows if row)


def html_table_text(c):
    return _over("string", html_rows, c)


#: A cell and the mark behind it, for each mark that may part cells: quoted (doubled quotes stand for one), else up to the mark.
_CELL = {m: re.compile(rf'\s*"((?:[^"]|"")*)"[^{re.escape(m)}]*(?:{re.escape(m)}|$)|([^{re.escape(m)}]*)(?:{re.escape(m)}|$)') for m in ("\t", "|", ",")}
_RULE = re.compile(r"[-:\s]*")


def _cells_of(line: str, mark: str) -> list[str]:
    out, at = [], 0
    while at <= len(line):
        found = _CELL[mark].match(line, at)
        quoted, plain = found.groups()
        out.append((plain if quoted is None else quoted.replace('""', '"')).strip())
        closed = found.end() > at and line[found.end() - 1 : found.end()] == mark
        at = found.end() if closed else len(line) + 1
    return out


def table_cells(text: str | None) -> list[list[str]]:
    """Cells of a linearised table, line by line: bars, the outer ones aside, part them where no line has a tab, commas where none has either.

    A line of nothing but dashes and colons is a rule and goes, as does an empty one.
    """
    body = re.sub(r"^[^\S\n]*\|*|\|*[^\S\n]*$", "", text or "", flags=re.MULTILINE)
    mark = "\t" if "\t" in body else "|" if "|" in body else ","
    split = (_cells_of(line, mark) for line in body.splitlines())
    return [cells for cells in split if not all(_RULE.fullmatch(c) for c in cells)]


def aligned_readings(tables: list) -> tuple[int, int, int, list[str]]:
    """(rows, columns, readings, values) of the tables of the most frequent shape, first seen at ties; values by row, column and reading, "" where a row ends early."""
    read = [table_cells(t) for t in tables]
    shapes = [(len(rows), max(map(len, rows), default=0)) for rows in read]
    modal = Counter(shapes).most_common(1)[0][0]  # equal counts come in the order of first sight
    kept = [rows for rows, shape in zip(read, shapes, strict=True) if shape == modal]
    values = [rows[r][c] if c < len(rows[r]) else "" for r in range(modal[0]) for c in range(modal[1]) for rows in kept]
    return *modal, len(kept), values


_ALIGNED = {"rows": pa.int32(), "cols": pa.int32(), "n": pa.int32(), "values": pa.list_(pa.string())}


def readings_aligned(c):
    """Arrays of linearised tables as aligned_readings."""

    def run(tables: pa.Array) -> pa.Array:
        made = [aligned_readings(t) for t in tables.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(_ALIGNED.values())], list(_ALIGNED))

    # else the optimiser would run it, and the grouping below, once for each field
    return F.arrow_udf(run, "rows int, cols int, n int, values array<string>").asNondeterministic()(c)


def merged_cell(texts: list[str], numbers: list) -> tuple[str, bool, bool]:
    """(text, are all readings numbers, do these differ): the median of numbers in general format, else the most frequent text, first seen at ties."""
    if None in numbers:
        alike = texts.count(texts[0]) == len(texts)
        return texts[0] if alike else Counter(texts).most_common(1)[0][0], False, False
    x = sorted(numbers, key=lambda v: (v != v, v))  # NaN is the greatest
    low, high = x[(len(x) - 1) // 2], x[len(x) // 2]
    apart = x[0] != x[-1] and x[0] == x[0]
    return f"{low if low == high else 0.5 * low + 0.5 * high:g}", True, apart


def merged_table(rows: int, cols: int, n: int, values: list[str], numbers: list) -> tuple[str, int, int]:
    """(CSV text, cells of numbers, those whose readings differ) of aligned values."""
    lines, count, differing = [], 0, 0
    for r in range(rows):
        line = []
        for at in range(r * cols * n, (r + 1) * cols * n, n):
            text, is_number, apart = merged_cell(values[at : at + n], numbers[at : at + n])
            count, differing = count + is_number, differing + apart
            line.append('"' + text.replace('"', '""') + '"' if re.search('[",\r\n]', text) else text)
        lines.append(",".join(line))
    return "\r\n".join(lines), count, differing


def readings_merged(rows, cols, n, values, numbers):
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array) -> pa.Array:
        made = [merged_table(*x) for x in zip(*(p.to_pylist() for p in (a, b, c, d, e)), strict=True)]
        kinds = {"linearized_table": pa.string(), "numbers": pa.int64(), "apart": pa.int64()}
        return pa.StructArray.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(kinds.values())], list(kinds))

    return F.arrow_udf(run, "linearized_table string, numbers long, apart long").asNondeterministic()(rows, cols, n, values, numbers)
