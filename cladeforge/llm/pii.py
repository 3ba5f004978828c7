"""Personal data in texts: fixed shapes, and identifiers found by their context.

Method: bootstrapped contextual extraction. Seed entities are the spans of the four fixed
shapes and, for secrets, runs of at least 32 hexadecimal digits. The tokens round a span,
words and marks alike, make lexical patterns of several widths. Patterns and the
identifier-like tokens they occur with (a digit, 6 to 64 characters, no punctuation at the
ends) form a graph that Spark scores in rounds: a pattern by the share of its instances
that are trusted, an instance by the patterns that trust it. Instances of high-confidence
patterns become spans of the kind `id`; the spans of the four shapes always stay, while a
seed of hexadecimal digits becomes a span only if some pattern confirms it.

A pattern is confident if it has enough trusted instances of its own and if the rarest of
its words goes with identifiers: at least SPECIFIC of all occurrences of that word, in the
whole corpus, stand in the pattern. So common words (`of _ the`) and marks alone (`| _ |`)
never make a pattern.

DataFrame functions only. The shapes are written so that matching takes time in
proportion to the text: runs are possessive and are entered at their start only, which
gives the same leftmost matches. Spans are made from the gaps between the matches by one
running sum, so their number doesn't make a text slower either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, write_table

LOCAL = "[A-Za-z0-9._%+-]"
SHAPES = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![\p{L}0-9_./:-])(?=[^\s0-9]{0,63}[0-9])[\p{L}0-9](?:[\p{L}0-9_./:-]{4,62}[\p{L}0-9])(?![\p{L}0-9_])"
#: Candidates that are seeds, though not spans by themselves.
SECRET = "^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,64}$"
FOUND = "id"
#: Rounds of scoring.
ROUNDS = 3
#: Trusted instances a pattern needs, and the scores that patterns and instances need.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 5, 0.8, 0.8
#: Share of a pattern's rarest word's occurrences that must stand in the pattern.
SPECIFIC = 0.5
#: Words, and single marks that are neither letters nor digits.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: Characters on either side in which the context words lie.
REACH = 80

#: Spans that are summed up together; see _running().
BLOCK = 64

SPAN = "struct<s: bigint, e: bigint, v: string, l: string, r: string>"


def spans(text: Column, regex: str) -> Column:
    """All matches in order: start, end (code points), value, text before and after.

    The context is cut from the gaps between matches.
    """
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)

    def of(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        size = F.size(hits)
        before = F.slice(gaps, F.lit(1), size)
        after = F.slice(gaps, F.lit(2), size)
        sizes = F.zip_with(before, hits, lambda g, h: F.struct(F.length(g).cast("long").alias("g"), F.length(h).cast("long").alias("h")))
        ends = _running(sizes)
        near = F.zip_with(before, after, lambda l, r: F.struct(F.substring(l, -REACH, REACH).alias("l"), F.substring(r, 1, REACH).alias("r")))
        placed = F.zip_with(ends, F.zip_with(hits, sizes, lambda v, n: F.struct(v.alias("v"), n["h"].alias("h"))), lambda e, x: F.struct(e.alias("e"), x["v"].alias("v"), x["h"].alias("h")))
        return F.zip_with(placed, near, lambda p, c: F.struct((p["e"] - p["h"]).alias("s"), p["e"].alias("e"), p["v"].alias("v"), c["l"].alias("l"), c["r"].alias("r")))

    # In an array of one, the lists of matches and of gaps are computed once.
    return F.transform(F.array(F.struct(hits.alias("hits"), gaps.alias("gaps"))), of)[0]


def _running(sizes: Column) -> Column:
    """Ends of successive stretches of g and h letters: sums over blocks of BLOCK, then
    within them, so that the work stays near the number of stretches."""
    block = lambda i: F.slice(sizes, i, F.lit(BLOCK))
    total = lambda xs, start: F.aggregate(xs, start, lambda n, x: n + x["g"] + x["h"])
    starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(BLOCK))
    empty = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("long")
    inner = lambda i: F.aggregate(block(i), F.struct(zero.alias("at"), empty.alias("out")), _append)["out"]
    offsets = F.aggregate(starts, F.struct(zero.alias("at"), empty.alias("out")), lambda a, i: F.struct(total(block(i), a["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    return F.flatten(F.zip_with(starts, offsets, lambda i, o: F.transform(inner(i), lambda e: e + o)))


def _append(a: Column, x: Column) -> Column:
    at = a["at"] + x["g"] + x["h"]
    return F.struct(at.alias("at"), F.concat(a["out"], F.array(at)).alias("out"))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).try_cast("int") <= 255))
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    needed = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    may = F.contains(text, F.lit(needed)) if needed else F.lit(True)
    if kind != "email":
        may = may & text.rlike("[0-9]")
    found = F.filter(spans(text, SHAPES[kind]), lambda x: _valid(kind, x["v"]))
    return F.when(may, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _candidates(text: Column) -> Column:
    return F.when(text.rlike("[0-9]"), spans(text, CANDIDATE)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs' columns given, and one array of spans for each shape and the candidates."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = docs.select("row", "doc_id", *[_base(text, k).alias(k) for k in SHAPES], _candidates(text).alias("other"))
    seen = F.concat(*[F.col(k) for k in SHAPES])
    clear = lambda c: ~F.exists(seen, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    return every.withColumn("other", F.filter("other", clear))


def _patterns(span: Column) -> Column:
    """Lexical patterns of a span, as structs pattern, words: the two or three tokens before
    it, and the one to three before it with the one after it; words are those it has."""
    left = F.regexp_extract_all(F.lower(span["l"]), F.lit(TOKEN), F.lit(0))
    right = F.slice(F.regexp_extract_all(F.lower(span["r"]), F.lit(TOKEN), F.lit(0)), 1, 1)

    def of(x: Column) -> Column:
        left, right = x["left"], x["right"]
        last = lambda n: F.slice(left, F.greatest(F.size(left) - n + 1, F.lit(1)), F.lit(n))
        parts = [(n, last(n), F.array().cast("array<string>")) for n in (2, 3)] + [(n, last(n), right) for n in (1, 2, 3)]
        words = lambda ts: F.array_distinct(F.filter(ts, lambda t: t.rlike(r"^[\p{L}_]")))
        whole = lambda n, a, b: (F.size(a) == n) & (F.size(words(F.concat(a, b))) > 0)
        made = [
            F.when(whole(n, a, b), F.struct(F.concat_ws(" ", a, F.array(F.lit("\x00")), b).alias("pattern"), words(F.concat(a, b)).alias("words")))
            for n, a, b in parts
        ]
        return F.array_compact(F.array(*made))

    return F.transform(F.array(F.struct(left.alias("left"), right.alias("right"))), of)[0]


def discovered(base: DataFrame, docs: DataFrame) -> DataFrame:
    """row, s, e of the candidate tokens that high-confidence patterns discover.

    base: rows row, the shapes' spans, other; docs: their texts. Scores are of distinct
    values, so copies of a text add nothing; occurrences count against the words of all texts.
    """
    pick = lambda col, seed: F.transform(col, lambda x: F.struct(x["v"].alias("v"), x["l"].alias("l"), x["r"].alias("r"), seed(x).alias("seed")))
    sure, maybe = (lambda x: F.lit(1.0)), (lambda x: F.when(x["v"].rlike(SECRET), 1.0).otherwise(0.0))
    every = base.select(F.explode(F.concat(*[pick(F.col(k), sure) for k in SHAPES], pick(F.col("other"), maybe))).alias("x"))
    pairs = every.select(F.lower("x.v").alias("value"), "x.seed", F.inline(_patterns(F.col("x"))))
    edges = pairs.groupBy("pattern", "words", "value").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    edges = write_table(edges)
    # Patterns that could ever have the support, and their share of their rarest word.
    wide = edges.groupBy("pattern", "words").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n")).where(F.col("values") >= SUPPORT)
    needed = wide.select("pattern", "n", F.explode("words").alias("word"))
    lone = needed.select("word").distinct()
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    said = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"[\p{L}_][\p{L}\p{N}_]*+"), F.lit(0))).alias("word"))
    counts = said.groupBy("word").agg(F.count(F.lit(1)).alias("times")).join(lone, "word", "left_semi")
    rarest = needed.join(counts, "word").groupBy("pattern", "n").agg(F.min("times").alias("times"))
    special = write_table(rarest.where(F.col("n") >= SPECIFIC * F.col("times")).select("pattern"))
    graph = write_table(edges.join(special, "pattern").select("pattern", "value", "seed"))
    trusted = graph.select("pattern", "value", F.col("seed").alias("trust"))
    for _ in range(ROUNDS):
        patterns = trusted.groupBy("pattern").agg(F.sum("trust").alias("support"), F.avg("trust").alias("score"))
        patterns = patterns.where((F.col("support") >= SUPPORT) & (F.col("score") >= PATTERN_SCORE)).select("pattern", "score")
        doubt = F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.99)))))
        instances = graph.join(patterns, "pattern").groupBy("value").agg((1 - doubt).alias("belief"))
        believed = graph.join(instances, "value", "left")
        trusted = write_table(
            believed.select("pattern", "value", F.greatest("seed", F.coalesce("belief", F.lit(0.0))).alias("trust"), "belief")
        )
    new = trusted.where(F.col("belief") >= INSTANCE_SCORE).select("value").distinct()
    tokens = base.select("row", F.explode("other").alias("x")).select("row", "x.s", "x.e", F.lower("x.v").alias("value"))
    return tokens.join(new, "value", "left_semi").select("row", "s", "e")


def located(docs: DataFrame) -> DataFrame:
    """row, doc_id, one array of structs s, e for each kind; docs has a column row."""
    base = write_table(base_spans(docs))
    found = discovered(base, docs).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias(FOUND))
    ends = lambda k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k)
    none = F.array().cast("array<struct<s: bigint, e: bigint>>")
    shapes = base.select("row", "doc_id", *[ends(k) for k in SHAPES])
    return shapes.join(found, "row", "left").withColumn(FOUND, F.coalesce(FOUND, none))


def _listed(kinds: list[str]) -> Column:
    line = lambda k: F.transform(k, lambda x: F.concat_ws(":", F.lit(k), x["s"], x["e"]))
    return F.array_join(F.concat(*map(line, kinds)), ",")


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_id, base_sha256, spans of every row.

    Null text counts as empty and has no spans (the digest is that of an empty string).
    Spans are kind:start:end in code points, end exclusive, in the order of the kinds and
    then of their starts. Repeated rows are repeated, null doc_ids kept, further columns
    ignored; an empty table gives no rows. A text of any length is looked at whole.
    """
    given = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kinds = [*SHAPES, FOUND]
    return located(given).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(_listed(list(SHAPES)).cast("binary"), 256).alias("base_sha256"),
        _listed(kinds).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of all kinds replaced by [KIND]; overlapping ones by the first.

    Rows without spans, null texts among them, are unchanged; columns are those of docs,
    whatever their names.
    """
    names = docs.columns
    row, cuts = unused("row__", names), unused("cuts__", names)
    held = write_table(docs.withColumn(row, F.monotonically_increasing_id()))
    places = located(held.select(F.col(row).alias("row"), "doc_id", "text"))
    cut_of = lambda k: F.transform(
        k, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.lit(f"[{k.upper()}]").alias("as"))
    )
    tagged = F.array_sort(F.concat(*map(cut_of, (*SHAPES, FOUND))))
    told = places.select(F.col("row").alias(row), tagged.alias(cuts)).where(F.size(cuts) > 0)
    text = F.col("text").cast("string")

    def pieces(kept: Column) -> Column:
        """What stands before each kept span, and its kind."""
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(kept, lambda x: -x["e"]))
        gaps = F.zip_with(F.slice(ends, F.lit(1), F.size(kept)), kept, lambda a, x: F.struct(a.alias("a"), x.alias("x")))
        made = F.transform(gaps, lambda g: F.concat(F.substring(text, (g["a"] + 1).cast("int"), (g["x"]["s"] - g["a"]).cast("int")), g["x"]["as"]))
        rest = F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(made, ""), rest)

    def apart(spans: Column) -> Column:
        """The spans, in order, that no kept one before them overlaps: of spans that overlap
        the first, which reaches as far as the furthest end before."""
        none = F.array().cast("array<struct<s: bigint, e: bigint, as: string>>")
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        add = lambda acc, x: F.when(x["s"] < acc["at"], acc).otherwise(F.struct((-x["e"]).alias("at"), F.concat(acc["out"], F.array(x)).alias("out")))
        return F.aggregate(spans, start, add)["out"]

    clean = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.transform(F.array(apart(F.col(cuts))), pieces)[0])
    return held.join(told, row, "left").withColumn("text", clean).select(*names)
