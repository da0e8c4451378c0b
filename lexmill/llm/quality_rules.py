"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document. The ledger keeps the measurements and one integer
whose bit r is set where rule r fails, and is written to the shared folder. Policies are versioned
masks over those bits, so a policy change or an ablation reads the stored ledger and never the texts
again; every rule's measurements are in it, so a threshold can be moved without them too.

Defined cases: a null text is a text without words; a null doc_id is kept as it is; repeated rows
each get their row; an empty table gives an empty ledger; columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD_GAP, materialize, table, texts

SYMBOLS = "#*$%&|<>"

#: name of each rule; its place is its bit
RULES = (
    "few_words",  # fewer than 50 words
    "repeated_windows",  # over half of the words stand in repeated 3-word windows
    "symbols",  # more than one symbol for ten words
    "repeated_lines",  # over 30 % of the lines with a word equal an earlier one
    "word_length",  # mean word length outside 2 to 20
    "upper_case",  # over half of the cased letters are capitals
    "no_letters",  # fewer than half of the words have a letter
)

#: version -> rules that reject. A version is never changed, a new one is added.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    # repeated lines alone do not reject here: the base rule on repeated windows covers texts that consist of them
    "v2": ("few_words", "repeated_windows", "symbols", "word_length", "upper_case", "no_letters"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "upper_case", "no_letters"),
}

_POS_BITS = 24
_POS_MASK = (1 << _POS_BITS) - 1


def mask_of(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _covered(positions: Column) -> Column:
    """How many words the 3-word windows that start at these positions cover together."""
    return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(p, p + 1, p + 2)))))


def _adjacent_equal(ordered: Column, key, at) -> Column:
    """Positions of the neighbours in a sorted array whose keys are equal."""
    n = F.size(ordered)
    pairs = F.zip_with(
        F.slice(ordered, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(ordered, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.when(key(a) == key(b), F.array(at(a), at(b))),
    )
    return F.flatten(F.filter(pairs, lambda p: p.isNotNull()))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of whole texts, with built-in functions only and without a shuffle.

    Repeated windows: each window's 64-bit hash; the sort key packs 40 bits of it with the window's
    place, so that the array of longs sorts fast. Where two different hashes share those 40 bits, or
    a text has more words than a place can hold, the whole hashes are sorted instead.
    """
    d = texts(docs, id_col, text_col)
    d = d.withColumn("words", F.array_remove(F.split("text", WORD_GAP), ""))
    d = d.withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ).withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("joined", F.array_join("words", ""))
    three = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    d = d.withColumn("windows", F.when(F.size("words") >= 3, three).otherwise(F.array().cast("array<bigint>")))
    packed = F.transform("windows", lambda h, i: F.shiftleft(h, _POS_BITS).bitwiseOR(i.cast("long")))
    d = d.withColumn("packed", F.sort_array(packed))
    near = _adjacent_equal(F.col("packed"), lambda x: F.shiftright(x, _POS_BITS), lambda x: x.bitwiseAND(F.lit(_POS_MASK)))
    d = d.withColumn("near", F.when(F.size("words") <= _POS_MASK, near))
    # near holds pairs of places; they must agree in their whole hashes
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("near") - 2, F.lit(2)),
        lambda i: F.get("windows", F.get("near", i).cast("int")) != F.get("windows", F.get("near", i + 1).cast("int")),
    )
    odd = F.when(F.col("near").isNull(), True).when(F.size("near") == 0, False).otherwise(F.exists(pairs, lambda x: x))
    whole = _adjacent_equal(
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))),
        lambda x: x["h"],
        lambda x: x["i"],
    )
    d = d.withColumn("repeats", F.when(odd, whole).otherwise(F.col("near")))
    upper = F.length("joined") - F.length(F.regexp_replace("joined", r"\p{Lu}+", ""))
    lower = F.length("joined") - F.length(F.regexp_replace("joined", r"\p{Ll}+", ""))
    measures = {
        "n_words": F.col("n_words"),
        "word_chars": F.length("joined"),
        "n_symbols": F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size("repeats") == 0, 0).otherwise(_covered(F.col("repeats"))),
        "n_upper": upper,
        "n_lower": lower,
        "n_letter_words": F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))),
    }
    # a generator of one row: a filter on a measure is not pushed below it, where it would repeat the work
    return d.select("doc_id", F.inline(F.array(F.struct(*[m.cast("long").alias(c) for c, m in measures.items()]))))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and the long `failed`: bit r is set where RULES[r] fails."""
    n = F.col("n_words")
    fails = {
        "few_words": n < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "upper_case": F.col("n_upper") > F.col("n_lower"),
        "no_letters": 2 * F.col("n_letter_words") < n,
    }
    bits = [F.when(fails[r], F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs, id_col, text_col).withColumn("failed", failed)


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written to the shared folder and read from there."""
    return materialize(ledger(docs), "quality-ledger")


def write_ledger(docs: DataFrame, path: str) -> None:
    """The ledger in a folder of its own, with the names of the rules in the order of their bits: later sessions
    apply policies and ablations to it without the texts."""
    ledger(docs).withColumn("rules", F.lit(",".join(RULES))).write.parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A stored ledger; refused where its bits stand for other rules than these."""
    rows = spark.read.parquet(path)
    other = rows.where(F.col("rules") != ",".join(RULES)).select("rules").first()
    if other:
        raise ValueError(f"the ledger in {path} has the rules {other['rules']}")
    return rows.drop("rules")


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """Adds `kept` by the version's mask."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0)


def keep(docs: DataFrame, version: str) -> DataFrame:
    """The rows, with all columns, that the version keeps. Rules see a row at a time, so the stored
    ledger carries the rows beside the measurements and no join is needed."""
    names = docs.columns
    rows = docs.select(F.struct("doc_id", F.struct(*names).alias("row")).alias("doc_id"), "text")
    kept = apply_policy(stored(rows), version).where("kept")
    return kept.select(*[F.col("doc_id.row").getField(c).alias(c) for c in names])


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """One row for each rule of the version: how many documents fail it, fail it alone (a policy
    without the rule would keep them), and all documents and rejects. Bits are summed in one
    aggregation, partial before the shuffle."""
    mask = mask_of(POLICIES[version])
    hit = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    names = POLICIES[version]
    sums = [F.count("*").alias("docs"), F.count_if(hit != 0).alias("rejected")]
    for r in names:
        bit = F.lit(1 << RULES.index(r)).cast("long")
        sums += [F.count_if(hit.bitwiseAND(bit) != 0).alias(f"f_{r}"), F.count_if(hit == bit).alias(f"o_{r}")]
    rows = rows.agg(*sums)
    each = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("fails"), F.col(f"o_{r}").alias("fails_alone")) for r in names
    ])
    return rows.select("docs", "rejected", F.inline(each))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_letter_words")


def op7_quality_ledger(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents under policy v2."""
    base = mask_of(POLICIES["base"])
    d = apply_policy(stored(table(spark, sf_dir, "documents")), "v2")
    return d.select("doc_id", *MEASURES, (F.col("failed").bitwiseAND(F.lit(base).cast("long")) != 0).alias("base_failed"), "kept", "failed")


def rule_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, and rejects alone, from the stored ledger."""
    return ablations(stored(table(spark, sf_dir, "documents")), "v1")


_W = r"[\x20\x09-\x0D]+"
_LEDGER = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_W}'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
k AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM k),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(array_to_string(ws, ''), '[^\p{{Lu}}]', '', 'g')) AS n_upper,
  length(regexp_replace(array_to_string(ws, ''), '[^\p{{Ll}}]', '', 'g')) AS n_lower,
  len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words
  FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
  + 8 * (10 * n_dup_lines > 3 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
  + 32 * (n_upper > n_lower)::INT + 64 * (2 * n_letter_words < n_words)::INT AS BIGINT) AS failed FROM m)
"""
ORACLE = f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, CAST(n_upper AS BIGINT) AS n_upper, CAST(n_lower AS BIGINT) AS n_lower,
  CAST(n_letter_words AS BIGINT) AS n_letter_words, (failed & 3) <> 0 AS base_failed, (failed & ~8) = 0 AS kept, failed FROM f
"""
ABLATIONS = f"""{_LEDGER}, rules AS (SELECT unnest(range(7)) AS bit, unnest([{", ".join(f"'{r}'" for r in RULES)}]) AS rule)
SELECT (SELECT count(*) FROM f) AS docs, (SELECT count(*) FROM f WHERE failed <> 0) AS rejected, rule,
  (SELECT count(*) FROM f WHERE (failed >> bit) & 1 = 1) AS fails, (SELECT count(*) FROM f WHERE failed = 1 << bit) AS fails_alone FROM rules
"""
