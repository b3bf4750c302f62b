"""Secret scan with multipart credential linking, with DataFrame functions only.

Base kinds are strong: ``assign`` (a named password, token or key), ``access`` (an access identifier) and ``hex`` (a
long hexadecimal run). Weak kinds are ordinary by themselves: ``login`` (a named user or client), ``endpoint`` (an
address with a scheme) and ``blob`` (a long token of letters, digits and signs). Each kind plays a role: access
identifier, secret or endpoint. A weak candidate is reported only if a base span of another role starts or ends
within ``scope`` code points of it in the same text; candidates that overlap a base span are that span, not a find
of their own. Base spans are always reported.

Places are code points, ends exclusive. The engine's functions give the matches of a text and the text between
them; running sums over both lengths give the places. Spans depend on the text alone, so they are found once per
different text (by SHA-256) and joined back; a text that fills a third of the rows is scanned where it lies and
linked once. A null text counts as empty and has no spans. Null or repeated ``doc_id`` values do not matter: every row gets its
own result. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import stored, whole_text

SCOPE = 300

# The kinds in the order in which spans of one start are listed, with pattern, role, and the group
# that must hold a number of characters. Patterns read alike in Java and RE2.
NAMED = r"""["']?\x20*[:=]\x20*["']?"""
KINDS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))" + NAMED + r"([A-Za-z0-9+/_.=-]+)", "secret", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", "access", 0, 20),
    ("hex", r"[0-9a-f]{24,}", "secret", 0, 24),
    ("login", r"((?i:client_?id|user_?name|user|login|account))" + NAMED + r"([A-Za-z0-9_.@-]+)", "access", 2, 3),
    ("endpoint", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9.:@/?&=_%#~-]+", "endpoint", 0, 8),
    ("blob", r"[A-Za-z0-9+/_=-]{32,}", "secret", 0, 32),
)
BASE = 3
NO_HITS = "array<struct<kind:int,gap:int,size:int,valid:boolean>>"
NO_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
# A cheap test that a text must pass before the pattern is tried.
NEEDS = {"access": "AKIA", "endpoint": "://"}


def _hits(text: Column, number: int) -> Column:
    """kind, gap before, length and validity of every match of one kind, in order."""
    name, pattern, _, group, least = KINDS[number]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    hits = F.zip_with(
        F.arrays_zip(whole.alias("m"), measured.alias("v")),
        F.slice(gaps, 1, F.size(whole)),
        lambda pair, gap: F.struct(
            F.lit(number).alias("kind"),
            F.length(gap).alias("gap"),
            F.length(pair["m"]).alias("size"),
            (F.length(pair["v"]) >= least).alias("valid"),
        ),
    )
    there = text.contains(NEEDS[name]) & text.rlike(pattern) if name in NEEDS else text.rlike(pattern)
    return F.when(there, hits).otherwise(F.expr(f"CAST(array() AS {NO_HITS})"))


def _roles(column: str) -> Column:
    return F.element_at(F.array(*[F.lit(role) for _, _, role, _, _ in KINDS]), F.col(column) + 1)


def _bins(first: Column, last: Column, scope: int) -> Column:
    return F.explode(F.sequence(F.floor(first / scope), F.floor(last / scope)))


def spans_by_text(texts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """digest, kind, start and end of every span, once per different text; ``texts`` has digest and body."""
    hits = F.concat(*[_hits(F.col("body"), number) for number in range(len(KINDS))])
    found = texts.select("digest", hits.alias("hits")).filter(F.size("hits") > 0)
    found = stored(found.dropDuplicates(["digest"]), "secret-hits")
    each = found.select("digest", F.posexplode("hits").alias("at", "hit")).select("digest", "at", "hit.*")
    stop = F.expr("sum(gap + size) OVER (PARTITION BY digest, kind ORDER BY at ROWS UNBOUNDED PRECEDING)")
    placed = each.withColumn("end", stop).filter("valid")
    placed = stored(
        placed.select("digest", "kind", (F.col("end") - F.col("size")).alias("start"), "end"), "secret-spans"
    )
    base = placed.filter(F.col("kind") < BASE)
    weak = placed.filter(F.col("kind") >= BASE)
    # Interval join: both sides are dealt over bins of the scope's width, the weak side with a margin of one scope.
    left = weak.withColumn("bin", _bins(F.col("start") - scope, F.col("end") + scope, scope))
    right = base.withColumn("bin", _bins(F.col("start"), F.col("end"), scope)).select(
        "digest", "bin", _roles("kind").alias("role"), F.col("start").alias("s"), F.col("end").alias("e")
    )
    met = left.join(right, ["digest", "bin"])
    apart = F.greatest(F.col("s") - F.col("end"), F.col("start") - F.col("e"))
    linked = (
        met.withColumn("apart", apart)
        .groupBy("digest", "kind", "start", "end")
        .agg(
            F.min("apart").alias("nearest"),
            F.max((F.col("role") != _roles("kind")) & F.col("apart").between(0, scope)).alias("complement"),
        )
        .filter("nearest >= 0 AND complement")
    )
    return base.unionByName(linked.select("digest", "kind", "start", "end"))


def _digested(docs: DataFrame) -> DataFrame:
    text = whole_text(docs)
    return docs.select(docs["doc_id"].alias("doc_id"), text.alias("body"), _digest(text).alias("digest"))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _lists(texts: DataFrame, scope: int) -> DataFrame:
    """The sorted spans of every text that has some."""
    spans = spans_by_text(texts, scope)
    one = F.struct("start", "kind", "end")
    return spans.groupBy("digest").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(name) for name, *_ in KINDS])
    said = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(said, ",")


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, all spans as text and as a list."""
    texts = _digested(docs)
    lists = stored(_lists(texts, scope), "secret-lists")
    rows = texts.select("doc_id", "digest").join(lists, "digest", "left")
    rows = rows.select("doc_id", F.coalesce("spans", F.expr(f"CAST(array() AS {NO_SPANS})")).alias("spans"))
    count = lambda number: F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.filter("spans", lambda s: s["kind"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def mask_secrets(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (spans that touch or overlap by one), and ``n_chars`` to match."""
    texts = _digested(docs)
    lists = stored(_lists(texts, scope), "secret-lists")
    rows = docs.withColumn("__digest", _digest(whole_text(docs)))
    rows = rows.join(lists.select(F.col("digest").alias("__digest"), F.col("spans").alias("__spans")), "__digest", "left")
    # Spans are sorted by start: what lies between the largest end so far and the next start stays.
    text = rows["text"]
    begin = lambda done: F.greatest(done["end"], F.lit(0))
    rest = lambda done: F.substring(text, (begin(done) + 1).cast("int"), F.length(text))
    between = lambda done, s: F.substring(text, (begin(done) + 1).cast("int"), (s["start"] - begin(done)).cast("int"))
    reached = F.aggregate(
        "__spans",
        F.struct(F.lit(-1).cast("long").alias("end"), F.lit("").alias("text")),
        lambda done, s: F.struct(
            F.greatest(done["end"], s["end"]).alias("end"),
            F.when(s["start"] > done["end"], F.concat(done["text"], between(done, s), F.lit(mask)))
            .otherwise(done["text"])
            .alias("text"),
        ),
        lambda done: F.concat(done["text"], rest(done)),
    )
    rows = rows.withColumn("__masked", F.when(F.col("__spans").isNull(), rows["text"]).otherwise(reached))
    changed = {"text": F.col("__masked")}
    if "n_chars" in docs.columns:
        counted = F.length("__masked").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(counted)
    return rows.select(*[changed.get(name, rows[name]).alias(name) for name in docs.columns])
