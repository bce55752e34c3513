"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions alone.

One pass over the texts finds candidate spans (three base kinds and vendor token shapes); all that follows works on the
settled candidates. Each candidate value's hash is counted over distinct owners and distinct repositories. A value that
many owners or many repositories hold is a copied example; a value that few hold is live-looking, and its place is added
as a span of kind ``owned``. Counting is a partial aggregate. The verdicts that come back to the spans are those of
copied values alone, each under ``SALTS`` keys, and a span looks under the key of its row's number: rows of a value that
a third of all texts hold are dealt over that many keys (and adaptive execution may split each further).

Defined cases: a null text is empty; a null owner or repository is one owner or repository of its own; repeated rows are
found each on its own; a table without rows gives none; values that overlap (a hex string inside an assignment) are
counted under the same hash; spans that start together are listed in the order of their kinds; a text of any length and
with any number of matches is read whole, in time that grows with its length (offsets are sums over blocks of
``STEP`` matches); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, settle

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, the group with the value, fewest characters of that value. Their order breaks ties in start.
BASE = (
    ("assign", _ASSIGN, 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are whole: the same spans as all runs less the short ones
)
VENDOR = (("vendor", r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|AIza[A-Za-z0-9_-]{30,}", 0, 14),)
#: What a text must hold for a kind to be looked for (on the lower-cased text): a cheap test before the patterns.
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_VENDOR_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "k_live_", "eyj", "aiza")
#: Owners, and repositories, from which on a value is an example that is copied around.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
#: Keys over which the verdict on a copied value is dealt; values of an array that are summed one after the other.
SALTS, STEP = 32, 256
_FOUND = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,value_start:bigint>>"


def no(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def running(values: Column, join=lambda a, b: a + b) -> Column:
    """For each of the longs ``values`` the sum (or what ``join`` makes) of it and all before it, in linear time: first
    over blocks, then inside each block."""

    def scan(v: Column, start: Column) -> Column:
        step = lambda s, x: once(join(s["at"], x), lambda y: F.struct(y.alias("at"), F.concat(s["out"], F.array(y)).alias("out")))
        return F.aggregate(v, F.struct(start.cast("long").alias("at"), no("array<bigint>").alias("out")), step, lambda s: s["out"])

    def over(v: Column) -> Column:
        part = lambda i: F.slice(v, i * STEP + 1, STEP)
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int"))
        sums = F.transform(numbers, lambda i: F.aggregate(part(i), F.lit(0).cast("long"), join))
        return once(scan(sums, F.lit(0)), lambda ends: F.flatten(F.transform(numbers, lambda i: scan(part(i), F.coalesce(F.get(ends, i - 1), F.lit(0))))))

    return once(values, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(no("array<bigint>")))


def spans(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Leftmost non-overlapping matches as structs, in order; what lies between matches gives their places."""
    whole, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(m: Column) -> Column:
        ends = running(F.transform(m["w"], lambda w, i: (F.length(w) + F.length(F.get(m["b"], i))).cast("long")))

        def item(x: Column) -> Column:
            value = F.regexp_extract(x["w"], pattern, group) if group else x["w"]
            return once(value, lambda v: F.struct(
                (x["e"] - F.length(x["w"])).cast("long").alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"), F.lit(kind).alias("kind"),
                F.when(F.length(v) >= least, F.sha2(v, 256)).alias("value"), (x["e"] - F.length(v)).cast("long").alias("value_start"),
            ))

        return F.filter(F.transform(F.arrays_zip(m["w"].alias("w"), ends.alias("e")), item), lambda x: x["value"].isNotNull())

    return once(F.struct(whole.alias("w"), between.alias("b")), placed)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def listed(items: Column) -> Column:
    """kind:start:end by start and then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository: Column) -> DataFrame:
    """One row per row of ``docs``: its id, its text's hash, owner, repository, and its candidate spans."""
    text, low = F.col("_t"), F.lower(F.col("_t"))
    tests = (contains_any(low, _WORDS), F.contains(text, F.lit("AKIA")), text.rlike("[0-9a-f]{24}"), contains_any(low, _VENDOR_WORDS))
    found = [F.when(test, spans(text, *kind, rank)).otherwise(no(_FOUND)) for rank, (test, kind) in enumerate(zip(tests, BASE + VENDOR))]
    return docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"), F.coalesce(repository, F.lit("")).alias("_repo")
    ).select("_id", F.xxhash64("_t").alias("_h"), "_owner", "_repo", F.concat(*found).alias("_found"), F.monotonically_increasing_id().alias("_row"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository: Column | None = None, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES
) -> DataFrame:
    """One row per row of ``docs``: _id, _h (its text's xxhash64), base (array of base spans), all_spans (those and the
    method's), owned (value spans of live-looking credentials), n_examples, most_owners and most_repositories (of its
    copied values). Without a ``repository`` an owner's texts of one language (column ``lang``, if there) count as one."""
    repository = F.concat_ws("/", owner_col, "lang") if repository is None and "lang" in docs.columns else F.col(owner_col) if repository is None else repository
    seen = settle(candidates(docs, id_col, text_col, owner_col, repository), "secrets")  # settled: each row keeps its number
    each = seen.where(F.size("_found") > 0).select("_row", "_owner", "_repo", F.explode("_found").alias("x"))
    stats = each.select(F.col("x.value").alias("value"), "_owner", "_repo").distinct().groupBy("value").agg(F.count_distinct("_owner").alias("owners"), F.count_distinct("_repo").alias("repositories"))
    copied = settle(stats.where((F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)), "copied")
    salted = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = each.select("_row", "x", F.col("x.value").alias("value"), F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["value", "salt"], "left")
    place = F.struct(F.col("x.value_start").alias("start"), F.lit(9).alias("rank"), F.col("x.end").alias("end"), F.lit("owned").alias("kind"))
    per_row = judged.groupBy("_row").agg(
        F.collect_set(F.when(F.col("owners").isNull(), place)).alias("live"), F.count("owners").alias("n_examples"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories")
    )
    pick = lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"))
    owned = F.array_sort(F.coalesce("live", F.expr("array()").cast(per_row.schema["live"].dataType)))
    base = F.transform(F.filter("_found", lambda x: x["rank"] < len(BASE)), pick)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = seen.join(per_row, "_row", "left")
    return out.select("_id", "_h", base.alias("base"), F.concat(F.transform("_found", pick), owned).alias("all_spans"), owned.alias("owned"), zero("n_examples"), zero("most_owners"), zero("most_repositories"))


def digest(scanned: DataFrame) -> DataFrame:
    """The scan as counts, a digest of the base spans, and a list of all spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        F.col("_id").alias("doc_id"), *[count(k[0]) for k in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("all_spans")).alias("spans"), F.size("owned").cast("long").alias("n_owned"), F.col("n_examples").cast("long").alias("n_examples"),
        F.col("most_owners").cast("long").alias("most_owners"), F.col("most_repositories").cast("long").alias("most_repositories"),
    )


def redact(text: Column, marks: Column, mask: str = "[secret]") -> Column:
    """``text`` with each of the spans ``marks`` (may overlap) replaced by ``mask``; a span that begins inside another
    has no mask of its own. The text is held in at most 513 blocks, so that a piece of it is found without a walk from its start."""

    def piece(b: Column, start: Column, end: Column) -> Column:
        def of(x: Column) -> Column:
            head, tail = F.get(b["parts"], x["i"]), F.get(b["parts"], x["j"])
            one = F.substring(head, x["a"], (x["e"] - x["s"]).cast("int"))
            more = F.concat(F.substring(head, x["a"], b["size"]), F.array_join(F.slice(b["parts"], x["i"] + 2, x["j"] - x["i"] - 1), ""), F.substring(F.coalesce(tail, F.lit("")), F.lit(1), F.pmod(x["e"], b["size"]).cast("int")))
            return F.when(x["e"] <= x["s"], F.lit("")).when(x["i"] == x["j"], one).otherwise(more)

        block = lambda n: F.floor(n / b["size"]).cast("int")
        return once(F.struct(start.alias("s"), end.alias("e"), block(start).alias("i"), block(end).alias("j"), (F.pmod(start, b["size"]) + 1).cast("int").alias("a")), of)

    def render(b: Column) -> Column:
        def over(m: Column) -> Column:
            ends = running(F.transform(m, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

            def each(e: Column) -> Column:
                before = lambda i: F.coalesce(F.get(e, i - 1), F.lit(0))
                shown = F.transform(m, lambda x, i: F.concat(piece(b, before(i), x["start"]), F.when((x["start"] >= before(i)), F.lit(mask)).otherwise("")))
                return F.concat(F.array_join(shown, ""), piece(b, before(F.size(m)), F.length(text).cast("long")))

            return once(ends, each)

        return once(F.array_sort(marks), over)

    size = F.greatest(F.lit(4096), F.ceil(F.length(text) / 512)).cast("int")
    parts = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), n), lambda i: F.substring(text, i + 1, n))
    return once(size, lambda n: once(F.struct(n.alias("size"), parts(n).alias("parts")), render))
