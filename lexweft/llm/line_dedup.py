"""Line dedup by winnowing, in DataFrame functions only.

Repeated passages start and end anywhere, so lines are wrapped at every word: the k-gram at a word is the line of GRAM
words that begins there. The least of each SPAN neighbouring k-grams, by a hash of their first two words, is a
fingerprint, so two documents that share GRAM + SPAN - 1 words share a window whole, hence a fingerprint. Fingerprints
are joined by hash, and each but the earliest place of one is a match. Matched k-grams cover a repeated run up to less
than SPAN words at both ends, as SPAN <= GRAM. There, matches are extended both ways, word by word.

What is cut from a run follows the text's own lines (ended by line feeds and by sentence ends): runs of LONG words and
more go whole; of shorter ones, lines that lie in them whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, made, release, scratch

#: Words of a k-gram, and positions of a window. Repeated runs of GRAM + SPAN - 1 = 29 words are always found, and words that
#: aren't in a repeated run of GRAM words never go.
GRAM = SPAN = 15
#: Words from which a run is cut wherever it starts and ends: by default all that are always found.
LONG = GRAM + SPAN - 1
#: Bytes of whole lines from which a shorter run is cut.
LEAST = 100
#: What separates words, as members of a class of a regular expression.
BLANK = " \\t\\r\\n"
#: Hashes of pairs under this are a third of all, and nearly always one of them is in a window.
SMALL = -(1 << 63) + (1 << 64) // 3
#: Pairs under it that are looked at on either side of one, to tell whether it's the least of a window.
NEAR = 6
#: Seconds after which the plan of a table that was written is let go of.
SETTLE = 1.0
#: Stands for a null doc_id in keys.
NO_ID = -(2**63)


def _keys() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("th")]


def _once(df: DataFrame, **columns: str) -> DataFrame:
    """Adds columns that are computed once for each row.

    Without the generator in between, the optimizer would copy them into the lambdas of later steps, which would
    compute whole arrays again for each element.
    """
    made = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    out = df.select(*df.columns, F.explode(F.expr(f"array(struct({made}))")).alias("_made"))
    return out.select(*df.columns, *[F.col(f"_made.{c}").alias(c) for c in columns])


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` is ``value``, computed once.

    Unlike a column of its own it isn't copied into rows, and slices of an array take only what they hold: of a column,
    Spark's interpreted ``slice`` unpacks the array whole each time.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


#: SQL: words of a text, and of words w a hash of the pair at each position, at the last one of that word alone.
WORDS = "split(trim(BOTH ' \\t\\r\\n' FROM text), '[ \\\\t\\\\r\\\\n]+')"
PAIRS = "zip_with(w, slice(w, 2, size(w)), (x, y) -> xxhash64(x, y))"


def _grams() -> Column:
    """The hash of the k-gram at i, from pairs that cover it.

    Outside of lambdas Spark compiles this, so positions are exploded first.
    """
    return F.xxhash64(*[F.get("p", F.col("i") + k) for k in sorted({*range(0, GRAM - 1, 2), GRAM - 2})])


def fingerprints(docs: DataFrame) -> DataFrame:
    """did, th, i (word at which it starts) and g (hash) of each fingerprint.

    A window's minimum is its first pair of the least hash. Minima are sought among the few pairs under a threshold: those
    that lie between two lesser ones less than a window apart are none. Windows without any such pair are
    searched one by one.
    """
    low = f"filter(sequence(0, size(p) - {GRAM}), i -> get(p, i) < {SMALL}L)"
    window = f"slice(p, a + 1, {SPAN})"
    least = f"array_distinct(transform(sequence(coalesce(get(low, j - 1), -1) + 1, i - {SPAN}), a -> a + cast(array_position({window}, array_min({window})) AS int) - 1))"
    rest = f"flatten(transform(concat(low, array(size(p) - {GRAM - 1})), (i, j) -> if(i - coalesce(get(low, j - 1), -1) > {SPAN}, {least}, cast(array() AS array<int>))))"
    found = _let("p", PAIRS, _let("low", low, f"struct(p, low, concat(low, {rest}) AS marks)"))
    own = docs.where("text is not null").select(*_keys(), "text")
    own = _once(own, found=_let("w", WORDS, f"if(size(w) < {GRAM + SPAN - 1}, null, {found})")).drop("text").where("found is not null")
    own = own.select("did", "th", "found.p", "found.low", F.posexplode("found.marks").alias("j", "i"))
    lesser = lambda step, sign: " ".join(f"WHEN get(p, get(low, j {step} {k})) {sign} get(p, i) THEN get(low, j {step} {k})" for k in range(1, NEAR + 1))
    inner = f"CASE {lesser('+', '<')} END - CASE {lesser('-', '<=')} END <= {SPAN}"
    return own.where(f"get(p, i) >= {SMALL}L OR NOT coalesce({inner}, false)").select("did", "th", "i", _grams().alias("g"))


def _met(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` joined with ``found`` (fewer and smaller rows) by did and th, at every size by the same plan."""
    return docs.join(found.hint("shuffle_hash"), ["did", "th"], how)


def _earliest(marks: DataFrame) -> DataFrame:
    """g and first (did, th, i), the earliest place, of k-grams that stand at several places."""
    made = marks.groupBy("g").agg(F.min(F.struct("did", "th", "i")).alias("first"), F.count("*").alias("copies"))
    return made.where("copies > 1").drop("copies")


def _matches(docs: DataFrame, before: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fingerprints (i, g) of each document that stand earlier, sorted in ``at``, and the earliest place of each g.

    Most fingerprints stand once, and go by a count before places are compared. Both joins meet written tables, so that
    Spark can split a fingerprint with very many places.
    """
    marks = scratch(fingerprints(docs), "marks")
    again = scratch(marks.groupBy("g").agg(F.count("*").alias("copies")).where("copies > 1").select("g"), "repeats")
    marks = scratch(marks.join(again.hint("shuffle_hash"), "g", "left_semi"), "repeated")
    discard(before, marks)
    first = scratch(_earliest(marks), "first")
    later = marks.join(first.hint("shuffle_hash"), "g").where(F.struct("did", "th", "i") != F.col("first"))
    return scratch(later.groupBy("did", "th").agg(F.sort_array(F.collect_set(F.struct("i", "g"))).alias("at")), "matches"), first


def _span(lo: str, hi: str, last: str) -> str:
    """SQL: positions of k-grams from ``lo`` to ``hi`` that there are, the last one's being ``last``."""
    lo, hi = f"greatest({lo}, 0)", f"least({hi}, {last})"
    return f"if({lo} <= {hi}, sequence({lo}, {hi}), cast(array() AS array<int>))"


def _extended(docs: DataFrame, matches: DataFrame, first: DataFrame, before: list[str]) -> DataFrame:
    """did, th and i: positions of k-grams around the open ends of runs of matches that stand earlier.

    A match has an open end where its k-gram doesn't overlap the next match's. The k-grams at all words up to SPAN - 1 away
    are looked up among those around the earliest places of the fingerprints there and around other open ends. That
    holds for all matches less than SPAN words from an open end, as the last one may be none in the document that
    shares the run. A place within a run isn't asked, as the k-grams that overlap there stand earlier themselves.
    """
    ends = _once(matches, own="at.i")
    ends = _once(
        ends,
        starts=f"filter(sequence(0, size(own) - 1), j -> coalesce(get(own, j - 1) + {GRAM} <= get(own, j), true))",
        stops=f"filter(sequence(0, size(own) - 1), j -> coalesce(get(own, j + 1) >= get(own, j) + {GRAM}, true))",
    )
    left = f"filter(sequence(j, least(j + {SPAN - 2}, size(own) - 1)), m -> get(own, m) - get(own, j) < {SPAN})"
    right = f"filter(sequence(greatest(j - {SPAN - 2}, 0), j), m -> get(own, j) - get(own, m) < {SPAN})"
    row = "struct(get(at, m) AS e, {l} AS l, {r} AS r, m = j AS edge)"
    open_ = [f"flatten(transform({js}, j -> transform({ms}, m -> {row.format(l=l, r=not l)})))" for js, ms, l in (("starts", left, True), ("stops", right, False))]
    ends = scratch(ends.select("did", "th", F.expr(f"inline(concat({', '.join(open_)}))")).select("did", "th", "e.*", "l", "r", "edge"), "ends")
    sides = ends.groupBy("g").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    origin = first.join(sides, "g").select("first.did", "first.th", "first.i", "l", "r", F.lit(False).alias("edge"))
    near = ends.select("did", "th", "i", "l", "r", "edge").union(origin).groupBy("did", "th").agg(F.collect_set(F.struct("i", "l", "r", "edge")).alias("near"))
    near = scratch(near, "near")
    discard(before, matches, near)
    texts = _met(docs.where("text is not null").select(*_keys(), "text"), near, "inner")
    texts = _once(texts, p=_let("w", WORDS, PAIRS)).drop("text")
    last = f"size(p) - {GRAM}"
    asked = f"transform(filter(near, e -> e.edge), e -> if(e.l, {_span(f'e.i - {SPAN - 1}', 'e.i - 1', last)}, {_span('e.i + 1', f'e.i + {SPAN - 1}', last)}))"
    spread = f"transform(near, e -> {_span(f'if(e.l, e.i - {SPAN - 1}, e.i)', f'if(e.r, e.i + {SPAN - 1}, e.i)', last)})"
    texts = _once(texts, asked=f"array_distinct(flatten({asked}))", spread=f"array_distinct(flatten({spread}))").drop("near")
    texts = _once(texts, at="concat(asked, array_except(spread, asked))")
    around = texts.select("did", "th", "p", "asked", F.posexplode("at").alias("j", "i")).select("did", "th", "i", _grams().alias("g"), F.expr("j < size(asked)").alias("asked"))
    around = scratch(around, "around")
    release(docs.sparkSession, SETTLE)  # the texts were shuffled whole; else these files stand beside those of the next step
    earliest = scratch(_earliest(around), "first-around")
    release(docs.sparkSession, SETTLE)
    return around.where("asked").join(earliest.hint("shuffle_hash"), "g").where(F.struct("did", "th", "i") != F.col("first")).select("did", "th", "i")


def repeated(docs: DataFrame) -> DataFrame:
    """did, th and at (sorted first words of later repeats of k-grams) of every document with some."""
    before = made()
    matches, first = _matches(docs, before)
    more = _extended(docs, matches, first, before).groupBy("did", "th").agg(F.collect_set("i").alias("more"))
    both = matches.join(more, ["did", "th"], "left")
    return both.select("did", "th", F.expr("sort_array(concat(at.i, coalesce(more, cast(array() AS array<int>))))").alias("at"))


def _runs(at: str) -> str:
    """SQL: runs (lo, hi) of words that the k-grams at sorted positions cover; those that meet are one."""
    starts = f"filter({at}, (p, j) -> j = 0 OR get({at}, j - 1) + {GRAM} < p)"
    stops = f"filter({at}, (p, j) -> coalesce(p + {GRAM} < get({at}, j + 1), true))"
    runs = f"zip_with({starts}, {stops}, (p, q) -> struct(p AS lo, q + {GRAM - 1} AS hi))"
    return f"filter({runs}, r -> r.hi - r.lo + 1 >= {GRAM + SPAN - 1})"


def _whole(long: int) -> str:
    """SQL: the runs, those under ``long`` words cut back to the whole lines in them."""
    lo = "if(r.lo = 0 OR array_contains(ends, r.lo - 1), r.lo, array_min(filter(ends, e -> e >= r.lo)) + 1)"
    hi = "coalesce(array_max(filter(ends, e -> e <= r.hi)), -1)"
    cut = f"transform(runs, r -> if(r.hi - r.lo + 1 >= {long}, r, struct({lo} AS lo, {hi} AS hi)))"
    text = "array_join(slice(tokens, r.lo + 1, greatest(r.hi - r.lo + 1, 0)), '')"
    return f"filter({cut}, r -> r.hi - r.lo + 1 >= {long} OR octet_length(trim(BOTH ' \t\r\n' FROM {text})) >= {LEAST})"


def dedup(docs: DataFrame, long: int = LONG) -> DataFrame:
    """``docs``, all columns kept, with repeated runs cut from text, and n_lines, n_removed and share_left added.

    Order: doc_id (nulls first), then a hash of the text, then the word; the earliest stays, overlapping repeats
    within a document included. Words are separated by blanks, tabs, line feeds and carriage returns, and compared as
    they are, whatever separates them. A line ends with a line feed or with a stop, ``!`` or ``?`` before a blank. Runs of
    ``long`` words go whole, by default all of 29 words and more; of shorter ones that are found, lines that lie in them
    whole, if they hold LEAST bytes. Blanks behind
    a word go with it, those before a line that goes too. Where words went, blanks at the end of the text go as well.

    n_lines counts line feeds and one, n_removed the lines cut whole or in part, share_left is the share of bytes that is
    left. Null text stays null, with 0 lines; empty texts stay. Rows equal in doc_id and text are one document and get
    the same result. Any text that Spark can hold goes. Existing columns of the
    added names are replaced. An empty table gives no rows.
    """
    before = made()
    runs = scratch(_once(repeated(docs), runs=_runs("at")).where("size(runs) > 0").select("did", "th", "runs"), "runs")
    discard(before, runs)
    release(docs.sparkSession, SETTLE)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed", "share_left")]
    # Documents' columns stand in a struct, so that none of them clashes with those made here.
    rows = docs.select(*_keys(), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    out = _met(rows, runs, "left").select("row", "row.text", "runs")
    bare = "ltrim(' \t\r\n', text)"
    tokens = f"split({bare}, '(?<=[{BLANK}])(?![{BLANK}])')"  # words with the blanks behind them
    short = f"exists(runs, r -> r.hi - r.lo + 1 < {long})"
    ends = f"if({short}, filter(sequence(0, size(tokens) - 1), j -> j = size(tokens) - 1 OR rlike(get(tokens, j), '\\n|[.!?] ')), null)"
    parts = "transform(sequence(0, size(cut)), c -> struct(coalesce(get(cut, c - 1).hi + 1, 0) AS lo, coalesce(get(cut, c).lo, size(tokens)) AS hi))"
    # Blanks between a line end and a line that goes are that line's.
    part = _let("s", "array_join(slice(tokens, p.lo + 1, p.hi - p.lo), '')", "if(endswith(rtrim(' \t', s), '\n'), rtrim(' \t', s), s)")
    ahead = f"if(get(cut, 0).lo = 0, '', left(text, char_length(text) - char_length({bare})))"
    kept = f"if(size(cut) > 0, rtrim(' \n\t\r', concat({ahead}, array_join(transform({parts}, p -> {part}), ''))), text)"
    lines = "aggregate(cut, 0, (n, r) -> n + size(split(trim(BOTH ' \t\r\n' FROM array_join(slice(tokens, r.lo + 1, r.hi - r.lo + 1), '')), '\\n[ \\t\\r\\n]*|[.!?] ')))"
    outcome = _let("tokens", tokens, _let("ends", ends, _let("cut", _whole(long), f"struct({kept} AS kept, {lines} AS n, size(cut) > 0 AS any)")))
    out = _once(out, made=f"if(runs IS NULL, null, {outcome})").drop("runs")  # only for documents with runs
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    n_removed = F.coalesce("made.n", F.lit(0))
    share = F.when(F.col("made.any"), F.octet_length("made.kept") / F.octet_length("text")).otherwise(1.0)
    own = [F.coalesce("made.kept", "text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in keep]
    return out.select(*own, n_lines.alias("n_lines"), n_removed.alias("n_removed"), share.alias("share_left"))
