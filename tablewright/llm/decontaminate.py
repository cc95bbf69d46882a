"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers and units become typed placeholders, so a question whose values were changed keeps its template.
Each window has two templates: words in small letters, whatever their case, and the same with every
capitalised word, sentence openers included, as a placeholder for a name.  Windows of a template are hashed
and joined with those of the benchmark; along one alignment, each value of the benchmark item must always
meet the same value of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.staging import stage

WINDOW = 8
#: Words of an item in consistent windows that show a passage.
MIN_WORDS = 13
#: Windows count together over so many neighbouring shifts; half as many words may be put in or left out between two.
BAND = 8
#: Items of fewer words are found only where they are the whole text: so few words also stand in clean text.
MIN_ITEM = 7
#: Marks of each of the two filters of benchmark windows (a fixed size; the join after them is exact).
MARKS = 1 << 17
# Units of measure and money that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons ml l liter liters litre litres "
    "s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars euro euros cent cents mph kmh"
).split()
NAME, UNIT, NUMBER = "\u0001", "\u0002", "\u0003"
#: Windows with more names than this have no template of names: it would fit any row of capitalised words.
MAX_NAMES = WINDOW // 2
_UNIT_AT = rf"(?i)(?<=[0-9]\s?)(?=(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))"
_TOKEN = r"\x02?\p{L}+|[0-9]+(?:[.,][0-9]+)*"


def raw_tokens(text: Column) -> Column:
    """Words and numbers in order; a unit starts with a mark."""
    clean = F.when(text.rlike("[\x01-\x03]"), F.translate(text, NAME + UNIT + NUMBER, "   ")).otherwise(text)
    marked = F.when(text.rlike("[0-9]"), F.regexp_replace(clean, F.lit(_UNIT_AT), F.lit(UNIT))).otherwise(clean)
    return F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0))


def template_token(token: Column) -> Column:
    """The placeholder of a unit or number; any other word in small letters."""
    number = F.when(token >= "0", F.lit(NUMBER)).otherwise(F.substring(token, 1, 1))
    return F.when(token < ":", number).otherwise(F.lower(token))


def is_name(token: Column) -> Column:
    """Whether a word has a capital first; its place and its neighbours don't count."""
    first = F.substring(token, 1, 1)
    return first != F.lower(first)


def _windows(table: DataFrame, key: str) -> DataFrame:
    """key, tokens, hashes (of the template's words), named (with names as placeholders) and n_windows.

    A text shorter than a window has one.  Hashes are used twice here, so the planner keeps them as a column.  A text without a word has one
    window of no words, left out by the callers: a filter here would compute the hashes once more.
    """
    tokens = table.select(key, raw_tokens(F.col("text")).alias("tokens"))
    made = tokens.select(key, "tokens", F.transform("tokens", lambda t: F.xxhash64(template_token(t))).alias("hashes"))
    named = F.zip_with("tokens", "hashes", lambda t, h: F.when(is_name(t), F.xxhash64(F.lit(NAME))).otherwise(h))
    made = made.select("*", named.alias("named"))
    return made.withColumn("n_windows", F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(1)))


def _mark(hashes: Column, at: Column, which: int, width: int = WINDOW) -> Column:
    """Place of a window in a filter: a hash of its words in order, for the second filter of all reversed.

    Nulls beyond a short text don't change a hash, so a shorter ``width`` gives the mark of the shorter item.
    """
    words = [F.get(hashes, at + (k - 1)) for k in range(width)]
    return F.hash(*(reversed(words) if which else words)).bitwiseAND(F.lit(MARKS - 1))


def _template(words: str) -> Column:
    """The template of a window's words; ``names`` tells which of the two."""
    return F.transform(words, lambda t: F.when(F.col("names") & is_name(t), F.lit(NAME)).otherwise(template_token(t)))


def _both(rows: DataFrame, words: str) -> DataFrame:
    """Each window with its templates: names False, and True where it has names, but not too many."""
    n = F.size(F.filter(words, is_name))
    named = (n > 0) & (n <= MAX_NAMES) & (n < F.size(words))
    rows = rows.select("*", F.explode(F.when(named, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("names"))
    return rows.withColumn("hash", F.xxhash64("names", _template(words)))


def benchmark_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, n_windows, at, names, mark0, mark1, words, hash) of all windows of the benchmark, staged.

    Items shorter than a window have one window of all their words.
    """
    made = _windows(benchmark.select(F.col(key).alias("item"), F.col(text).alias("text")), "item")
    rows = made.withColumn("at", F.explode(F.sequence(F.lit(1), "n_windows")))
    rows = rows.withColumn("words", F.slice("tokens", F.col("at"), WINDOW)).where(F.size("words") > 0)
    rows = _both(rows, "words")
    hashes = F.when(F.col("names"), F.col("named")).otherwise(F.col("hashes"))
    marks = [_mark(hashes, F.col("at"), k).alias(f"mark{k}") for k in (0, 1)]
    return stage(rows.select("item", "n_windows", "at", "names", *marks, "words", "hash").distinct(), "benchmark")


def _marks(windows: DataFrame, mark: str) -> Column:
    """A filter: a bit for each of MARKS marks, 1 at the mark of each window; a literal of fixed size in the plan.

    Every plan that Spark keeps or writes to its log has the literal as text, so it is packed: 64 marks a number.
    """
    bit = F.expr(f"shiftleft(1L, {mark} & 63)").alias("bit")
    words = windows.groupBy(F.shiftright(mark, 6).alias("place")).agg(F.bit_or(bit).alias("bit")).toArrow()
    filled = dict(zip(words["place"].to_pylist(), words["bit"].to_pylist(), strict=True))
    numbers = (filled.get(place, 0) for place in range(MARKS // 64))
    # the least long has no literal of its own
    return F.expr(f"array({', '.join(f'{n}L' if n > -(1 << 63) else f'{n + 1}L - 1L' for n in numbers)})")


def _is_marked(marks: Column, mark: Column) -> Column:
    return F.getbit(F.get(marks, F.shiftright(mark, 6)), mark.bitwiseAND(F.lit(63))) == 1


def matched_windows(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of documents that have the template of a benchmark window.

    Most windows are dropped by filters of fixed size inside their row; the rest are joined by the
    hash of their template and confirmed on the template itself.
    """
    filters = [_marks(windows, f"mark{k}") for k in (0, 1)]
    made = _windows(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), "doc")

    def kept(width: int) -> Column:
        def marked(at: Column) -> Column:
            def fits(hashes: Column) -> Column:
                first, second = (_is_marked(f, _mark(hashes, at, k, width)) for k, f in enumerate(filters))
                return first & second

            # one lambda for both, so the plan holds each filter once
            return F.exists(F.array("hashes", "named"), fits)

        # words go with their window: exploding beside the array of all words would copy it for every window
        number = F.col("n_windows") if width == WINDOW else F.size("hashes") - (width - 1)
        return F.transform(
            F.filter(F.when(number > 0, F.sequence(F.lit(1), number)).otherwise(F.array().cast("array<int>")), marked),
            lambda at: F.struct(at.alias("at"), F.slice("tokens", at, width).alias("words")),
        )

    lengths = windows.select(F.size("words").alias("n")).where(F.col("n").between(MIN_ITEM, WINDOW - 1)).distinct()
    widths = [WINDOW, *sorted(r["n"] for r in lengths.collect())]
    kept = F.concat(*[kept(w) for w in widths]) if len(widths) > 1 else kept(WINDOW)
    rows = made.select("doc", F.explode_outer(kept).alias("w")).where("w IS NOT NULL")
    rows = rows.select("doc", F.col("w.at").alias("doc_at"), F.col("w.words").alias("doc_words"))
    rows = _both(rows, "doc_words")
    joined = rows.join(windows.withColumnsRenamed({"at": "item_at", "words": "item_words"}).drop("mark0", "mark1"), ["hash", "names"])
    return joined.where(_template("doc_words") == _template("item_words"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item, n_windows, verbatim): documents that hold an item or 13 words of it.

    Words of the item in matching windows are counted along an alignment, each word once.  An alignment is
    one shift (the distance of the windows' places in document and item) or a band of BAND neighbouring
    shifts, as a value of another length, or a word put in or left out, moves what follows it.  A slot is a
    placeholder's value; a window counts only if, along its alignment, its slots' values pair up one to one:
    a benchmark value with two values in the document, or the reverse, makes all windows with it
    inconsistent.  verbatim: all slots are equal in the best
    alignment.  Null and empty texts never match; a row with a null id is left out, as nothing could
    name it.  Rows that share an id are judged together.  Documents' extra columns are ignored.
    """
    windows = benchmark_windows(benchmark.where(F.col(item).isNotNull()), item, item_text)
    found = stage(matched_windows(docs.where(F.col(key).isNotNull()), windows, key, text), "matches")
    shift = F.col("doc_at") - F.col("item_at")
    bands = [F.floor((shift + k * (BAND // 2)) / BAND) for k in (0, 1)]
    lines = [F.struct(F.lit(k).alias("kind"), n.cast("long").alias("n")) for k, n in enumerate((shift, *bands))]
    width = F.size("item_words").alias("width")
    found = found.select(
        "doc", "item", F.array(*lines).alias("lines"), "n_windows", "item_at", width, "names",
        _slots("item_words", "doc_words").alias("slots"),
    )
    found = found.withColumn("alignment", F.explode("lines")).drop("lines")
    line = ["doc", "item", "alignment"]
    values = found.select(*line, F.explode("slots").alias("s")).select(*line, "s.was", "s.now").distinct()
    forth = values.groupBy(*line, "was").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    back = values.groupBy(*line, "now").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    window = [*line, "item_at", "names"]
    slotted = found.where(F.size("slots") > 0).select(*window, F.explode("slots").alias("s"))
    slotted = slotted.select(*window, "s.was", "s.now")
    wrong = (
        slotted.join(forth, [*line, "was"], "left_semi").select(*window)
        .union(slotted.join(back, [*line, "now"], "left_semi").select(*window))
        .distinct()
    )
    good = found.join(wrong, window, "left_anti")
    changed = F.exists("slots", lambda s: s["was"] != s["now"])
    once = good.groupBy(*line, "item_at").agg(
        F.max("width").alias("width"),
        F.max("n_windows").alias("of"),
        F.bool_or(changed).alias("changed"),
    )
    step = F.col("item_at") - F.lag("item_at").over(Window.partitionBy(*line).orderBy("item_at"))
    once = once.withColumn("new", F.least("width", F.coalesce(step, "width")))
    per = once.groupBy(*line).agg(
        F.sum("new").alias("covered"),
        (~F.bool_or("changed")).alias("verbatim"),
        F.count(F.lit(1)).cast("int").alias("matched"),
        F.max(F.col("of") + F.col("width") - 1).alias("words"),
    )
    best = per.groupBy("doc", "item").agg(F.max(F.struct("covered", "verbatim", "matched", "words")).alias("b"))
    enough = F.col("b.covered") >= F.least(F.lit(MIN_WORDS), F.col("b.words"))
    return best.where(enough).select(
        F.col("doc").alias(key),
        F.col("item").alias(item),
        F.col("b.matched").alias("n_windows"),
        F.col("b.verbatim").alias("verbatim"),
    )


def _slots(was: str, now: str) -> Column:
    """The placeholders of a window: benchmark value and document value in small letters."""
    pairs = F.zip_with(was, now, lambda a, b: F.struct(a.alias("was"), b.alias("now")))
    slots = F.filter(pairs, lambda p: (p["was"] < ":") | (F.col("names") & is_name(p["was"])))
    return F.transform(slots, lambda p: F.struct(F.lower(p["was"]).alias("was"), F.lower(p["now"]).alias("now")))
