"""Answer parsing, comparison and normalisation.

Result sets are stored as Python-literal text (``"[('V Kohli', 973)]"``), which Spark cannot read. So
Arrow-batched functions read both answers of an item and compare them: only the raw texts are shuffled
before them and three numbers come out. Answers of the common shape are read and paired for a whole batch of items at once by array
functions, others item by item.
"""

from __future__ import annotations

import ast
from collections import defaultdict, namedtuple
from itertools import product
from math import floor, isfinite

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

#: kind: null, str or value; text as X1 has it; num if the cell reads as a number.
Cell = namedtuple("Cell", "kind text num")
# Markers that make an answer string a failed execution.
FAILURE_MARKERS = ("ERROR", "Time Out")
FAILED = object()
COMPARED = StructType([StructField("executed", BooleanType()), StructField("n_gold", IntegerType()),
                       StructField("n_gen", IntegerType()), StructField("matches", IntegerType())])
# White space as Python's str.strip() knows it.
WHITE_SPACE = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                       0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at its ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal(text: str, otherwise):
    try:
        return ast.literal_eval(text)
    except Exception:  # noqa: BLE001 - the reader raises many kinds on arbitrary text
        return otherwise


def to_cell(value) -> Cell:
    if value is None:
        return Cell("null", None, None)
    try:
        num = float(value)
    except (TypeError, ValueError, OverflowError):
        num = None
    return Cell("str" if isinstance(value, str) else "value", str(value).strip().lower(), num)


def answer_rows(answer) -> list[list[Cell]] | None:
    """The rows of an answer, None if it failed.

    A text with a failure marker, or that is no literal, failed. What is no list has no rows. An item of a list is a
    row; a text item is read as a literal if it is one; what is no sequence is a row of one cell.
    """
    if isinstance(answer, str):
        answer = FAILED if any(m in answer for m in FAILURE_MARKERS) else _literal(answer, FAILED)
    if answer is FAILED:
        return None
    items = answer if isinstance(answer, list) else ()
    values = (_literal(x, x) if isinstance(x, str) else x for x in items)
    return [[to_cell(c) for c in (v if isinstance(v, (list, tuple)) else (v,))] for v in values]


# --- X8: column-type classes ----------------------------------------------

# Name keywords per class, first class with a hit wins.
COLUMN_TYPE_KEYWORDS = [
    ("STRIKE_RATE", ["strike", "rate", "economy"]),
    ("AVERAGE", ["average", "avg"]),
    ("RUNS", ["run", "score", "total"]),
    ("STRING", ["name", "player", "team", "venue", "city"]),
]
DEFAULT_TYPE = "DEFAULT_NUM"
# Fixed value: every class uses the same absolute tolerance.
TOLERANCE = 1.0


def column_type(name: Column) -> Column:
    def typed(lname: Column) -> Column:
        expr = F
        for label, words in COLUMN_TYPE_KEYWORDS:
            expr = expr.when(F.rlike(lname, F.lit("|".join(words))), F.lit(label))
        return expr.otherwise(F.lit(DEFAULT_TYPE))

    return let(F.lower(name), typed)


def column_types(names: Column) -> Column:
    """The class of each name; none for a null."""
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), column_type)


def cell_match(gold: Cell, gen: Cell, kind: str) -> bool:
    """NULLs equal only each other; STRING class or a string gold cell compares cleaned text; numbers
    compare within the tolerance (inclusive); a cell that is no number falls back to cleaned text."""
    if "null" in (gold.kind, gen.kind):
        return gold.kind == gen.kind
    if kind == "STRING" or gold.kind == "str" or gold.num is None or gen.num is None:
        return gold.text == gen.text
    return abs(gold.num - gen.num) <= TOLERANCE


class _Group:
    """Generated rows that agree in width, NULLs and STRING cells, with numpy columns for the other cells.

    Up to ``AXES`` numeric columns, those with the most different values, form a grid: numbers within the tolerance lie in
    the same or in neighbouring cells, so a row meets those of 3 ** AXES cells only, in row order.
    """

    AXES = 3
    #: A little over the tolerance, so that a difference rounded down to it is no more than a cell.
    CELL = TOLERANCE * 1.001

    def __init__(self, gen: list[list[Cell]], rows: list[int], free: list[int]):
        self.free, self.n = free, len(rows)
        self.alive, self.left = np.ones(self.n, dtype=bool), self.n
        cells = {c: [gen[i][c] for i in rows] for c in free}
        self.text = {c: np.array([x.text for x in cells[c]], dtype=object) for c in free}
        self.none = {c: np.array([x.num is None for x in cells[c]], dtype=bool) for c in free}
        self.num = {c: np.array([np.nan if x.num is None else x.num for x in cells[c]], dtype=float) for c in free}
        finite = [c for c in free if np.isfinite(self.num[c]).all()]
        self.axes = sorted(finite, key=lambda c: -len(np.unique(self.num[c])))[:self.AXES]
        self.first, self.grid, self.texts = 0, defaultdict(list), {}
        if self.axes:
            places = np.floor(np.stack([self.num[c] for c in self.axes], axis=1) / self.CELL)
            for i, place in enumerate(map(tuple, places.tolist())):
                self.grid[place].append(i)
            self.grid = {place: np.array(rows, dtype=np.int64) for place, rows in self.grid.items()}
            self.steps = list(product((-1, 0, 1), repeat=len(self.axes)))

    def candidates(self, row: list[Cell]) -> np.ndarray:
        """Rows that may match, in row order; dead ones may be among them."""
        exact = [c for c in self.free if row[c].kind == "str" or row[c].num is None]
        if self.axes and not any(c in exact or not isfinite(row[c].num) for c in self.axes):
            at = [floor(row[c].num / self.CELL) for c in self.axes]
            found = []
            for step in self.steps:
                # A whole float finds the same entry as its int.
                cell = tuple([a + b for a, b in zip(at, step)])
                if cell in self.grid:
                    self.grid[cell] = rows = self.grid[cell][self.alive[self.grid[cell]]]
                    found.append(rows)
            return np.sort(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
        if exact:
            c = max(exact, key=lambda c: len(self._by_text(c)))
            return np.array(self._by_text(c).get(row[c].text, ()), dtype=np.int64)
        return np.arange(self.n)

    def _by_text(self, c: int) -> dict:
        if c not in self.texts:
            self.texts[c] = defaultdict(list)
            for i, text in enumerate(self.text[c]):
                self.texts[c][text].append(i)
        return self.texts[c]

    def take(self, row: list[Cell]) -> bool:
        """Use up the first row that is left and matches; whether there was one."""
        if not self.left:
            return False
        if not self.free:
            self.alive[self.first], self.first, self.left = False, self.first + 1, self.left - 1
            return True
        at = self.candidates(row)
        at = at[self.alive[at]]
        if not len(at):
            return False
        for c in self.free:
            cell = row[c]
            same = self.text[c][at] == cell.text
            if cell.kind != "str" and cell.num is not None:
                with np.errstate(invalid="ignore"):
                    near = np.abs(self.num[c][at] - cell.num) <= TOLERANCE
                same = np.where(self.none[c][at], same, near)
            at = at[same.astype(bool)]
            if not len(at):
                return False
        self.alive[at[0]], self.left = False, self.left - 1
        return True


def greedy_matches(gold: list[list[Cell]], gen: list[list[Cell]], types: list[str]) -> int:
    """E5: gold rows in order, each taking the first unused generated row of equal width whose cells all match.

    It is not a maximum matching: the tolerance is not transitive, so the order decides.
    """
    kind = lambda c: types[c] if c < len(types) else DEFAULT_TYPE

    def key(row):
        return tuple((x.kind == "null", x.text if kind(c) == "STRING" else None) for c, x in enumerate(row))

    rows = defaultdict(list)
    for i, row in enumerate(gen):
        rows[key(row)].append(i)
    groups: dict[tuple, _Group] = {}
    n = 0
    for row in gold:
        k = key(row)
        if k not in rows:
            continue
        if k not in groups:
            groups[k] = _Group(gen, rows[k], [c for c, (null, text) in enumerate(k) if not null and text is None])
        n += groups[k].take(row)
    return n


@F.pandas_udf(COMPARED)
def compare_answers(gold: pd.Series, generated: pd.Series, types: pd.Series) -> pd.DataFrame:
    """E1, E2 and E5 of one item: gold answer lines, generated answer text, column classes."""
    known: dict[tuple, list] = {}
    out = []
    for lines, text, kinds in zip(gold, generated, types):
        lines = () if lines is None else tuple(lines)
        if lines not in known:
            known[lines] = answer_rows(list(lines)) or []
        want, got = known[lines], answer_rows(text)
        out.append((got is not None, len(want), len(got or ()),
                    greedy_matches(want, got, list(kinds) if kinds is not None else []) if got and want else 0))
    return pd.DataFrame(out, columns=["executed", "n_gold", "n_gen", "matches"])


# --- E1 and E5 of common answers, a batch at a time ------------------------------

#: What a plain text holds neither inside nor, in the second class, at its ends: what would end or escape it, separators, brackets,
#: control characters, white space beyond a blank, and two letters whose lower case depends on the reader.
_NOT_IN_TEXT = r"""\\\x00-\x1F\x7F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\u0130\u03A3()\[\],"""
#: A cell that can be read without Python's reader: a quoted text, a plain number that Python prints as it stands, or None.
PLAIN_CELL = "(?:" + "|".join(f"{q}(?! )(?:\\w++|[^{_NOT_IN_TEXT}{no}])*+(?<! ){q}" for q, no in (("'", "'\""), ('"', '"'))) + \
    r"|-?[1-9][0-9]{0,14}|0|-?(?:0|[1-9][0-9]{0,9})\.(?:0|[0-9]{0,3}[1-9])|None)(?=[,)])"
#: A tuple of such cells; a text alone between parentheses is no tuple. Repeats keep what they took, so long answers need no deep stack.
PLAIN_ROW = rf"\({PLAIN_CELL}(?:,(?=\))|(?:, {PLAIN_CELL})++,?+)\)"
#: Stands between the lines of a gold answer and the cells of a row's key; no plain cell holds it.
_LINE_END = "\x01"
MATCHED = StructType([StructField("n_gen", IntegerType()), StructField("matches", IntegerType())])


def are_plain_lines(lines: Column) -> Column:
    """Whether all lines of a gold answer are tuples of plain cells; null for a null."""
    shape = rf"^{PLAIN_ROW}(?:{_LINE_END}{PLAIN_ROW})*+\z"
    # A line that is null is not among the joined ones.
    return (F.size(lines) == 0) | (~F.array_contains(F.transform(lines, lambda x: x.isNull()), True)
                                   & F.rlike(F.array_join(lines, _LINE_END), F.lit(shape)))


def plain_lines(lines: Column) -> Column:
    """The lines of a gold answer that are tuples of plain cells, else null."""
    return F.when(are_plain_lines(lines), lines)


def is_plain_answer(text: Column) -> Column:
    """Whether a generated answer is a list of tuples of plain cells."""
    return F.coalesce((text == "[]") | F.rlike(text, F.lit(rf"^\[{PLAIN_ROW}(?:, {PLAIN_ROW})*+\]\z")), F.lit(False))


def is_failed(text: Column) -> Column:
    """An answer with a failure marker."""
    hit = F.lit(False)
    for m in FAILURE_MARKERS:
        hit = hit | F.contains(text, F.lit(m))
    return F.coalesce(hit, F.lit(False))


class _Rows:
    """Plain rows of many items: ``item`` of each row, its ``first`` cell and ``width``, and of each cell its row, place, text and number."""

    def __init__(self, texts: pa.Array, item: np.ndarray):
        cells = pc.split_pattern(pc.utf8_rtrim(texts, ","), ", ")
        offsets = cells.offsets.to_numpy()
        self.offsets, self.item = cells.offsets, item
        self.first, self.width = offsets[:-1], np.diff(offsets)
        self.row = np.repeat(np.arange(len(item)), self.width)
        self.place = np.arange(len(self.row)) - self.first[self.row]
        text = cells.values
        quoted, null = pc.or_(pc.starts_with(text, "'"), pc.starts_with(text, '"')), pc.equal(text, "None")
        self.quoted, self.null = (x.to_numpy(zero_copy_only=False) for x in (quoted, null))
        number = pc.invert(pc.or_(quoted, null))
        self.number = number.to_numpy(zero_copy_only=False)
        self.value = pc.if_else(number, text, pa.scalar(None, text.type)).cast(pa.float64()).to_numpy(zero_copy_only=False)
        bare = pc.if_else(quoted, pc.utf8_lower(pc.utf8_slice_codeunits(text, 1, -1)), text)
        # A text or number differs from None, whatever it reads.
        self.text = pc.if_else(null, "n", pc.binary_join_element_wise("'", bare, ""))


def _first_places(order: np.ndarray) -> np.ndarray:
    """Whether each of some sorted numbers is the same as the one before."""
    return np.concatenate(([False], order[1:] == order[:-1])) if len(order) else np.zeros(0, dtype=bool)


def match_plain_rows(gold: _Rows, gen: _Rows, n: int, of_text) -> tuple[np.ndarray, np.ndarray]:
    """E5 of ``n`` items at once: (matches, whether they hold for sure).

    A column is compared as text if ``of_text`` (item, column) says so or all its gold cells are quoted, as number if no cell of it is
    quoted; an item with another column is not sure. With different texts in every row, on either side, a row has one partner at most and
    the greedy order does not matter; an item with two rows alike on a side is not sure.
    """
    width = np.zeros(n, dtype=np.int64)
    for rows in (gold, gen):
        np.maximum.at(width, rows.item, rows.width)
    first = np.concatenate(([0], np.cumsum(width)))
    column = [first[rows.item[rows.row]] + rows.place for rows in (gold, gen)]
    count = lambda side, mask: np.bincount(column[side][mask], minlength=first[-1])
    item, place = of_text
    shown = place < width[item]
    as_text = count(0, gold.number) == 0
    as_text[first[item[shown]] + place[shown]] = True
    as_number = ~as_text & (count(0, gold.quoted) == 0) & (count(1, gen.quoted) == 0)
    sure = np.ones(n, dtype=bool)
    sure[np.repeat(np.arange(n), width)[~(as_text | as_number)]] = False

    keys = pa.chunked_array([pc.binary_join(pa.ListArray.from_arrays(rows.offsets, pc.if_else(pa.array(as_text[c]), rows.text, "")), _LINE_END)
                             for rows, c in zip((gold, gen), column)], pa.string()).combine_chunks().dictionary_encode()
    code = np.concatenate((gold.item, gen.item)).astype(np.int64) * max(len(keys.dictionary), 1) + keys.indices.to_numpy()
    codes = code[:len(gold.item)], code[len(gold.item):]
    orders = [np.argsort(c, kind="stable") for c in codes]
    for rows, c, order in zip((gold, gen), codes, orders):
        sure[rows.item[order][_first_places(c[order])]] = False

    known = codes[0][orders[0]]
    at = np.searchsorted(known, codes[1])
    met = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == codes[1])) if len(known) else np.zeros(0, dtype=np.int64)
    partner = orders[0][at[met]]
    # Equal keys have equal widths, so cells of partners stand side by side.
    pair = np.repeat(np.arange(len(met)), gen.width[met])
    step = np.arange(len(pair)) - np.repeat(np.cumsum(gen.width[met]) - gen.width[met], gen.width[met])
    b, a = gen.first[met][pair] + step, gold.first[partner][pair] + step
    near = (gold.null[a] & gen.null[b]) | (np.abs(gold.value[a] - gen.value[b]) <= TOLERANCE)
    far = np.bincount(pair[as_number[column[1][b]] & ~near], minlength=len(met)) > 0
    return np.bincount(gen.item[met[~far]], minlength=n), sure


@F.arrow_udf(MATCHED)
def match_plain(gold: pa.Array, generated: pa.Array, types: pa.Array) -> pa.Array:
    """Generated rows and E5 of items whose answers are both plain; null where one is null. Items that :func:`match_plain_rows` is not sure of are matched one by one."""
    there = pc.and_(gold.is_valid(), generated.is_valid())
    lines, texts, kinds = (x.filter(there) for x in (gold, generated, types))
    n = len(texts)
    size = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
    want = _Rows(pc.utf8_slice_codeunits(lines.flatten(), 1, -1), np.repeat(np.arange(n), size))
    some = np.flatnonzero(pc.not_equal(texts, "[]").to_numpy(zero_copy_only=False))
    split = pc.split_pattern(pc.utf8_slice_codeunits(texts.take(pa.array(some)), 2, -2), "), (")
    got = _Rows(split.flatten(), np.repeat(some, pc.list_value_length(split).to_numpy(zero_copy_only=False)))
    n_kinds = pc.fill_null(pc.list_value_length(kinds), 0).to_numpy(zero_copy_only=False)
    item = np.repeat(np.arange(n), n_kinds)
    place = np.arange(len(item)) - np.repeat(np.cumsum(n_kinds) - n_kinds, n_kinds)
    string = pc.fill_null(pc.equal(kinds.flatten(), "STRING"), False).to_numpy(zero_copy_only=False)
    matches, sure = match_plain_rows(want, got, n, (item[string], place[string]))
    for i in np.flatnonzero(~sure):
        matches[i] = greedy_matches(answer_rows(lines[i].as_py()), answer_rows(texts[i].as_py()), kinds[i].as_py() or [])
    places = np.full(len(there), -1)
    places[there.to_numpy(zero_copy_only=False)] = np.arange(n)
    places = pa.array(places, mask=places < 0)
    columns = [pa.array(x, pa.int32()).take(places) for x in (np.bincount(got.item, minlength=n), matches)]
    return pa.StructArray.from_arrays(columns, names=["n_gen", "matches"])


def compare_shaped(gold: Column, generated: Column, types: Column, n_gold: Column, failed: Column) -> Column:
    """struct(plain, executed, n_gold, n_gen, matches): E1, E2 and E5 of a failed answer and of one that is plain as the gold one is, ``plain`` false for a null."""
    m = match_plain(gold, F.when(~failed, generated), types)
    zero = F.lit(0)
    return F.struct((failed | m["n_gen"].isNotNull()).alias("plain"), (~failed).alias("executed"), n_gold.alias("n_gold"),
                    F.when(failed, zero).otherwise(F.coalesce(m["n_gen"], zero)).alias("n_gen"), F.coalesce(m["matches"], zero).alias("matches"))


def compare_plain(gold: Column, generated: Column, types: Column, n_gold: Column) -> Column:
    """``compare_shaped`` of any answers: ``gold`` holds the lines of ``plain_lines``, ``generated`` the other answer's text."""
    failed = is_failed(generated)
    return compare_shaped(gold, F.when(failed | is_plain_answer(generated), generated), types, n_gold, failed)


# --- X9 / X13: text normalisation -------------------------------------------

ERROR_FLAG = "ERROR_FLAG"


def normalize_answer(col) -> Column:
    """Bare lower-case text; error/timeout -> ERROR_FLAG; Python list/tuple
    punctuation removed; a number that is integral prints without '.0'."""
    c = F.col(col) if isinstance(col, str) else col

    def number(num: Column) -> Column:
        whole = (num == F.floor(num)) & (F.abs(num) < 9e15)
        return F.when(num.isNull() | F.isnan(num), F.lit(None)).when(whole, F.floor(num).cast("long").cast("string")).otherwise(float_text(num))

    def bare(text: Column) -> Column:
        # Spark also reads '5f' and '1d' as numbers, Python does not.
        python_number = F.rlike(text, F.lit(r"(?:[0-9.]|inf|infinity|nan)$"))
        return F.coalesce(let(F.when(python_number, text.try_cast("double")), number), text)

    def flagged(low: Column) -> Column:
        return F.when(low.contains("error") | low.contains("timeout"), F.lit(ERROR_FLAG)).otherwise(
            let(strip(F.regexp_replace(low, r"""[\[\]\(\),'"]""", "")), bare))

    return F.coalesce(let(F.lower(strip(c.cast("string"))), flagged), F.lit(""))


def normalize_cell(col) -> Column:
    """Cell to trimmed lower-case text, numbers as Python prints them, NULL -> 'none'."""
    c = F.col(col) if isinstance(col, str) else col
    text = c.cast("string")
    # The type is known when the plan is made, so one branch is left.
    shown = F.when(F.typeof(c).isin("double", "float"), float_text(text.try_cast("double"))).otherwise(text)
    return F.coalesce(F.lower(strip(shown)), F.lit("none"))


def float_text(num: Column) -> Column:
    """A double as Python prints it: Spark's ``1.0E-5`` is ``1e-05``, its ``1.0E7`` is ``10000000.0``."""
    def printed(text: Column) -> Column:
        digits, power = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).try_cast("int")
        plain = F.regexp_replace(F.format_string("%.17f", num), "0+$", "")
        short = F.concat(F.regexp_replace(digits, r"\.0$", ""), F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                         F.lpad(F.abs(power).cast("string"), 2, "0"))
        long = F.regexp_replace(num.cast("decimal(38,16)").cast("string"), r"(\.\d+?)0+$", "$1")
        return F.when(F.isnan(num), F.lit("nan")).when(text.endswith("Infinity"), F.replace(text, F.lit("Infinity"), F.lit("inf"))).when(
            ~F.contains(text, F.lit("E")), text).when((power >= 16) | (power < -4), short).otherwise(
            F.when(power >= 7, long).otherwise(plain))

    return F.when(num.isNotNull(), let(num.cast("string"), printed))
