"""Quality rules: how far a document's character classes and common words lie from those of known languages.

Each document gets two histograms: code points by character class, and counts of common words (all other words in one bin).
The same histograms are summed over all documents of each language; a document's divergence is the Jensen-Shannon
distance (base 2, square root) to the nearest of these references. Short documents say too little: below `min_chars` or
`min_words` a divergence is not judged. Only DataFrame functions run here.

How far is too far comes from the corpus: the sum of both distances is judged against a fence for each size of document, put
above the median by the spread of the half below it, which junk does not reach while it is less than half of the texts.

Nulls and empty texts: no words, all counts 0, rejected by the minimum length. A null or unknown language only means that the
document feeds no reference; it is judged like every other. Repeated rows and ids are judged one by one. Of languages at equal
distances any gives the same verdict; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, fresh_name, own_columns, without, written

# Common function words of each reference language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
}
# Character classes as regular-expression sets. Blanks are a class too; what is in none (mostly a-z) is the last.
PLAIN = "a-z\\x20\\x09-\\x0D"
CHAR_CLASSES = {
    "upper": "A-Z",
    "digit": "0-9",
    "stop": ".,;:!?'\"()\\-",
    "symbol": "#*$%&|<>=+/_@~^\\\\{}\\[\\]`",
    "letter": "\\x{C0}-\\x{24F}",
}
# The finer classes that distances are taken over: sentence stops, delimiters and quotes apart, a bin for each symbol.
FINE_CLASSES = {"upper": "A-Z", "digit": "0-9", "stop": ".!?", "comma": ",;:", "quote": "'\"()\\-", "letter": CHAR_CLASSES["letter"]}
SYMBOLS = "#*$%&|<>=+/_@~^\\{}[]`"


@dataclass(frozen=True)
class QualityRules:
    """max_class_distance, max_word_distance: largest distances that are kept in any corpus; min_chars, min_words: below these
    the distances are not judged; languages: whose documents make the references; spreads, least_gap: how far the fence lies
    above the median, in spreads of the lower half and at least; least_texts: sizes with fewer texts are pooled with others."""

    max_class_distance: float = 0.26
    max_word_distance: float = 0.75
    min_chars: int = 200
    min_words: int = 50
    languages: tuple[str, ...] = ("en", "de", "fr", "es")
    spreads: float = 6.0
    least_gap: float = 0.15
    least_texts: int = 50


def vocabulary() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words})


def window_hashes(words: Column) -> Column:
    """A hash of each 3-word window; null under four words, where no window can repeat."""
    return F.when(F.size(words) >= 4, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))))


def repeated_words(hashes: Column) -> Column:
    """How many words lie in 3-word windows that occur at least twice; hashes: a column from window_hashes()."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.transform(F.array(ordered), lambda o: F.zip_with(o, F.slice(o, 2, 1 << 30), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))))
    hits = F.array_distinct(F.flatten(F.filter(F.flatten(pairs), lambda p: p.isNotNull())))
    covered = F.size(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(i, i + 1, i + 2)))))
    # most texts repeat no window, and need no sorting
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and both histograms as arrays of counts."""
    vocab = vocabulary()
    base = docs.select("doc_id", "lang", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    base = base.select("doc_id", "lang", "t", F.xxhash64("t").alias("text_hash"), blank_words(F.col("t")).alias("w"), F.regexp_replace("t", f"[{PLAIN}]+", "").alias("rest"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = base.select(
        "doc_id", "lang", "text_hash", "rest", F.regexp_replace("rest", f"[^{CHAR_CLASSES['symbol']}]+", "").alias("symbols"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length("t").cast("long").alias("n_chars"),
        lines.alias("lines"),
        window_hashes(F.col("w")).alias("hashes"),
        F.concat(F.lit("  "), F.array_join(F.filter("w", lambda x: x.isin(vocab)), "  "), F.lit("  ")).alias("common"),
    )
    only = lambda s: F.length(F.regexp_replace("rest", f"[^{s}]+", "")).cast("long")
    each = lambda s: (F.length("symbols") - F.length(F.replace("symbols", F.lit(s), F.lit("")))).cast("long")
    found = [((F.length("common") - F.length(F.replace("common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in vocab]
    out = base.select(
        "doc_id", "lang", "text_hash", "n_words", "word_chars", "n_chars",
        only("#*$%&|<>").alias("n_symbols"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_kinds"),
        repeated_words(F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.array(*[only(s) for s in FINE_CLASSES.values()], *[each(s) for s in SYMBOLS], F.col("n_chars") - F.col("word_chars")).alias("classes"),
        F.array(*found).alias("found"),
    )
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(
        "doc_id", "lang", "text_hash", "n_words", "word_chars", "n_symbols", (F.col("n_lines") - F.col("n_kinds")).cast("long").alias("n_dup_lines"), "n_repeat_words", "n_chars",
        F.concat("classes", F.array(F.col("n_chars") - total(F.col("classes")))).alias("class_counts"),
        F.concat("found", F.array(F.col("n_words") - total(F.col("found")))).alias("word_counts"),
    )


def references(feats: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """One row per language: summed histograms. Sums combine on the map side; there are at most len(languages) rows."""
    n_class, n_word = len(FINE_CLASSES) + len(SYMBOLS) + 2, len(vocabulary()) + 1
    sums = lambda c, n: F.array(*[F.sum(F.get(F.col(c), F.lit(i))) for i in range(n)])
    return feats.where(F.col("lang").isin(*languages)).groupBy("lang").agg(sums("class_counts", n_class).alias("ref_classes"), sums("word_counts", n_word).alias("ref_words"))


def shares(counts: Column) -> Column:
    """Counts over their sum, as doubles; null if the sum is 0."""
    scaled = lambda s: F.transform(s["a"], lambda x: x / s["n"])
    summed = F.aggregate(counts, F.struct(F.lit(0).cast("long").alias("n")), lambda s, x: F.struct((s["n"] + x).alias("n")), lambda s: F.when(s["n"] > 0, s["n"].cast("double")))
    # a one-element array binds the sum once for all elements
    return F.get(F.transform(F.array(F.struct(counts.alias("a"), summed.alias("n"))), scaled), F.lit(0))


def js_distance(p: Column, q: list[float]) -> Column:
    """Square root of the base-2 Jensen-Shannon divergence of shares p from a reference's shares q."""
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    parts = F.zip_with(p, F.array(*[F.lit(v) for v in q]), lambda x, y: half(x, y) + half(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def fences(judged: DataFrame, rules: QualityRules) -> dict[int, float]:
    """The largest kept sum of distances by the bits of n_words, from the distinct texts that pass the base."""
    step = 0.001
    # at most 1414 steps for each of some 25 sizes reach the driver
    rows = judged.where("not base_failed and total is not null").groupBy("bits", F.floor(F.col("total") / step).alias("at")).agg(F.countDistinct("text_hash").alias("n")).collect()
    out = {}
    sizes = sorted({r["bits"] for r in rows})
    for bits in sizes:
        # shorter texts scatter more, so that pooling with them only widens the fence; longer ones are the last resort
        for pool in [*({b for b in sizes if low <= b <= bits} for low in range(bits, min(sizes) - 1, -1)), set(sizes)]:
            held = sorted((r["at"], r["n"]) for r in rows if r["bits"] in pool)
            if sum(n for _, n in held) >= rules.least_texts:
                break
        reach = lambda share: next(at for i, (at, _) in enumerate(held) if sum(n for _, n in held[: i + 1]) >= share * sum(n for _, n in held)) * step  # noqa: E731, B023
        middle = reach(0.5)
        out[bits] = middle + max(rules.least_gap, rules.spreads * (middle - reach(0.25)))
    return out


def quality_verdicts(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): base counts, both distances, base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: not base_failed and, where long
    enough to judge, within both distances of the nearest reference and within the fence of its size. With no reference at all nothing can be judged and the
    base decides alone.
    """
    feats = written(features(docs), "quality-features")
    # at most len(rules.languages) rows reach the driver
    refs = sorted(references(feats, rules.languages).collect(), key=lambda r: r["lang"])
    of = lambda counts: [x / max(1, sum(counts)) for x in counts]

    def nearest(col: str, key: str) -> Column:
        found = [js_distance(F.col(col), of(r[key])) for r in refs]
        return F.least(*found) if len(found) > 1 else (found or [F.lit(None).cast("double")])[0]

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = feats.withColumns({"class_shares": shares(F.col("class_counts")), "word_shares": shares(F.col("word_counts"))}).select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(F.col("n_chars") >= rules.min_chars, nearest("class_shares", "ref_classes")).alias("class_distance"),
        F.when(F.col("n_words") >= rules.min_words, nearest("word_shares", "ref_words")).alias("word_distance"),
        F.length(F.bin("n_words")).alias("bits"),
    )
    judged = written(judged.withColumn("total", F.col("class_distance") + F.col("word_distance")), "quality-distances")
    fence = F.lit(None).cast("double")
    for bits, most in sorted(fences(judged, rules).items()):
        fence = F.when(F.col("bits") == bits, F.lit(most)).otherwise(fence)
    far = F.coalesce(F.col("total") > fence, F.lit(False))
    far = far | (F.coalesce("class_distance", F.lit(0.0)) > rules.max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > rules.max_word_distance)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).drop("bits", "total")


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs without the rows that quality_verdicts rejects. Rows are told apart by id and text, so equal rows go or stay together;
    further columns stay as they are, whatever their names."""
    key, text = fresh_name(docs, "key"), fresh_name(docs, "text_hash")
    gone = quality_verdicts(docs, rules).where(~F.col("kept")).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key), F.col("text_hash").alias(text)).distinct()
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text: F.xxhash64(F.coalesce("text", F.lit("")))})
    return without(keyed, gone, [key, text], broadcast_rows).select(*own_columns(docs))
