"""Secret scan with multipart credential linking.

Certain patterns are reported by themselves. Weak candidates (identifiers, bare secrets, endpoints)
are reported only when the complementary parts stand within one scope of ``SCOPE`` code points.

Defined cases: a null or empty text has no spans; a weak candidate that overlaps a certain span is
part of it and not reported again; repeated rows are scanned alike; ties in position are ordered by
kind; columns of the input may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.llm.sieve import sifted
from labelwright.llm.store import save

#: Parts this near to each other, in code points between their starts, belong together.
SCOPE = 400
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: kind, pattern, group to measure, least length of it, role of the part; in the order of output.
CERTAIN = [
    ("assign", ASSIGN, 2, 8, "secret"),
    ("access", "AKIA[A-Z0-9]+", 0, 16, "identifier"),
    ("hex", "[0-9a-f]{32,}", 0, 32, "secret"),
]
WEAK = [
    ("identifier", "(?i:(access_?key_?id|account_?id|client_?id|user_?name|login))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=@-]+)", 2, 4, "identifier"),
    ("key", "[A-Za-z0-9/+]{40,}", 0, 40, "secret"),
    ("endpoint", "[a-z]{2,10}://[A-Za-z0-9.:@/_-]+", 0, 12, "endpoint"),
]
MARK = "[SECRET]"


def _matches(text: Column, kind: str, place: int, pattern: str, group: int, least: int) -> Column:
    """Every match of one kind: its number, the length of the gap before it, its own length, whether it counts.

    Splitting at a pattern gives the gaps between the very matches that extracting all of it gives.
    """
    none = F.lit(None).cast("array<struct<kind:string,place:int,i:int,gap:int,len:int,ok:boolean>>")
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    found = F.transform(
        F.arrays_zip(whole.alias("w"), part.alias("p"), F.slice(gaps, F.lit(1), F.size(whole)).alias("g")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(place).alias("place"), i.alias("i"),
            F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("len"), (F.length(x["p"]) >= least).alias("ok"),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(none)


def parts(rows: DataFrame) -> DataFrame:
    """One row per counting match of ``rows`` (rid, found): rid, kind, place, role, weak, start, end."""
    each = rows.where(F.size("found") > 0).select("rid", F.explode("found").alias("m")).select("rid", "m.*")
    before = W.partitionBy("rid", "place").orderBy("i")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).where("ok")
    roles = {kind: role for kind, *_, role in CERTAIN + WEAK}
    role = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r in roles.items()])
    return each.select("rid", "kind", "place", role.alias("role"), (F.col("place") >= len(CERTAIN)).alias("weak"), (F.col("end") - F.col("len")).alias("start"), "end")


def linked(found: DataFrame) -> DataFrame:
    """The parts to report: certain ones, and weak ones with their complements in scope.

    The interval join is an equi-join on cells of one scope's length. A cell gives the first and
    last start of each role; in the cell itself any part is near, in the cell before only the last
    can be nearest, in the cell after the first. So each part meets three rows, however many
    parts a scope holds. An identifier needs a secret, a secret an identifier, an endpoint both.
    """
    # overlap with a certain span: the farthest end before, the nearest start after
    sure = lambda c: F.when(~F.col("weak"), F.col(c))
    left = W.partitionBy("rid").orderBy("start", "place").rowsBetween(W.unboundedPreceding, W.currentRow)
    right = W.partitionBy("rid").orderBy(F.desc("start"), F.desc("place")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = found.withColumns({"_end": F.max(sure("end")).over(left), "_start": F.min(sure("start")).over(right)})
    clash = F.col("weak") & (F.coalesce(F.col("_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_start") < F.col("end"), F.lit(False)))
    found = found.where(~clash).withColumn("cell", F.floor(F.col("start") / SCOPE)).drop("_end", "_start")
    needs = ("identifier", "secret")
    cells = found.where(F.col("role").isin(*needs)).groupBy("rid", "cell").agg(
        *[f(F.when(F.col("role") == r, F.col("start"))).alias(f"{r}_{n}") for r in needs for n, f in (("first", F.min), ("last", F.max))]
    )
    weak = found.where("weak").select("*", F.explode(F.array(*[F.struct((F.col("cell") + d).alias("at"), F.lit(d).alias("d")) for d in (-1, 0, 1)])).alias("near"))
    weak = weak.select(*found.columns, "near.*")
    here = cells.select(F.col("rid").alias("r"), F.col("cell").alias("at"), *[c for c in cells.columns if c not in ("rid", "cell")])
    met = weak.join(here, (F.col("rid") == F.col("r")) & (weak["at"] == here["at"]))

    def near(role: str) -> Column:
        s = F.col("start")
        reach = F.when(F.col("d") == 0, F.col(f"{role}_first").isNotNull())
        reach = reach.when(F.col("d") == -1, s - F.col(f"{role}_last") <= SCOPE).otherwise(F.col(f"{role}_first") - s <= SCOPE)
        return F.max(F.coalesce(reach, F.lit(False))).alias(f"has_{role}")

    key = ["rid", "kind", "place", "role", "start", "end"]
    seen = met.groupBy(*key).agg(*[near(r) for r in needs])
    whole = seen.where(
        ((F.col("role") == "identifier") & F.col("has_secret"))
        | ((F.col("role") == "secret") & F.col("has_identifier"))
        | ((F.col("role") == "endpoint") & F.col("has_secret") & F.col("has_identifier"))
    )
    return found.where("not weak").select(*key).unionByName(whole.select(*key))


def scan(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns as ``row`` with ``spans``: every reported (start, place, kind, end), sorted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lists = [_matches(text, kind, k, pattern, group, least) for k, (kind, pattern, group, least, _) in enumerate(CERTAIN + WEAK)]
    none = F.array().cast("array<struct<kind:string,place:int,i:int,gap:int,len:int,ok:boolean>>")
    found = F.flatten(F.array(*[F.coalesce(x, none) for x in lists]))
    rows = save(docs.select(F.struct(*carry).alias("row"), F.monotonically_increasing_id().alias("rid"), found.alias("found")), "secrets")
    spans = (
        linked(parts(rows))
        .groupBy("rid")
        .agg(F.array_sort(F.collect_list(F.struct("start", "place", "kind", "end"))).alias("spans"))
    )
    spans = save(spans, "spans")
    empty = F.array().cast(spans.schema["spans"].dataType)
    # most texts hold nothing; they are not shuffled
    marked = sifted(rows.select("rid", "row"), spans, "rid")
    some = marked.where("maybe").join(spans, "rid", "left").select("row", F.coalesce("spans", empty).alias("spans"))
    return some.unionByName(marked.where("NOT maybe").select("row", empty.alias("spans")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every reported span replaced by a mark; other columns as they are.

    Spans that overlap or touch are replaced together. A column n_chars follows the new text.
    """
    out = scan(docs, docs.columns)
    first = F.struct(F.array().cast("array<struct<s:bigint,e:bigint>>").alias("done"), F.lit(None).cast("bigint").alias("s"), F.lit(None).cast("bigint").alias("e"))
    # spans are few; merge them in order: close the open stretch when the next one starts beyond it
    joined = F.aggregate(
        "spans",
        first,
        lambda a, x: F.when(a["s"].isNull(), F.struct(a["done"].alias("done"), x["start"].alias("s"), x["end"].alias("e")))
        .when(x["start"] <= a["e"], F.struct(a["done"].alias("done"), a["s"].alias("s"), F.greatest(a["e"], x["end"]).alias("e")))
        .otherwise(F.struct(F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))).alias("done"), x["start"].alias("s"), x["end"].alias("e"))),
        lambda a: F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))),
    )
    out = out.withColumn("cuts", F.when(F.size("spans") > 0, joined))
    text, cuts = F.col("row.text"), F.col("cuts")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(cuts)),
        lambda i: F.substring(
            text,
            (F.coalesce(F.get(cuts, i - 1)["e"], F.lit(0)) + 1).cast("int"),
            (F.coalesce(F.get(cuts, i)["s"], F.length(text)) - F.coalesce(F.get(cuts, i - 1)["e"], F.lit(0))).cast("int"),
        ),
    )
    out = out.withColumn("clean", F.when(cuts.isNull(), text).otherwise(F.array_join(pieces, MARK)))
    fresh = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
