"""Secret scan with corpus-wide ownership frequency (operator 5, built-ins only).

Candidates are regex matches of three kinds.  Their value hashes are counted
over the distinct owners and repositories that hold them in the whole corpus:
a value that stands with many owners is a copied example, one that stays with
one owner looks like a live credential.  Owner-specific values are then also
found where they stand bare, without the assignment around them (added spans).

Defined results: null text counts as empty, empty or secret-free texts return
zero counts and the hash of the empty string, repeated rows return one row
each, an empty table an empty result; null owners and repositories count as
one owner (repository) of their own; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import materialize, regex_spans

# The candidate patterns and their least lengths.
ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}+"
KINDS = ("assign", "access", "hex")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_spans``: array<struct<start, rank, kind, end, value>> of all base
    matches of a row, sorted by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))

    def typed(kind: str, spans, value, keep):
        rank = KINDS.index(kind)
        out = F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            s["end"].alias("end"), value(s["hit"]).alias("value")))
        return F.filter(out, keep)

    has_word = t.rlike("(?i)passw|secret|token|api_?key")
    assign = typed("assign", regex_spans(t, ASSIGN, has_word),
                   lambda h: F.regexp_extract(h, ASSIGN, 2), lambda s: F.length(s["value"]) >= 6)
    access = typed("access", regex_spans(t, ACCESS, t.contains("AKIA")), lambda h: h, lambda s: F.lit(True))
    hexes = typed("hex", regex_spans(t, HEX), lambda h: h, lambda s: F.lit(True))
    return docs.withColumn("_spans", F.array_sort(F.concat(assign, access, hexes)))


def ownership(spans: DataFrame) -> DataFrame:
    """Per value hash: distinct owners, distinct repositories and occurrences,
    from rows (hash, owner, repo).  Counted in two steps, so a value that a
    third of all rows share is combined before each shuffle."""
    per = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = per.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"),
                                        F.sum("n").alias("n_uses"))


def _words(text: str):
    """Credential-like words of a text (the kind "bare")."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.transform(regex_spans(t, VALUE, t.rlike("[0-9]")), lambda b: F.struct(
        b["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("bare").alias("kind"),
        b["end"].alias("end"), b["hit"].alias("value")))


def _all_spans():
    """Base spans and the words outside all of them."""
    return F.concat("_spans", F.filter("_words", lambda b: ~F.exists(
        "_spans", lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"]))))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source",
         repo: str = "lang", max_owners: int = 1) -> DataFrame:
    """Every row of ``docs`` as (id, base, added): ``base`` all base spans and
    ``added`` the bare words whose value is a live credential elsewhere, both
    array<struct<start, rank, kind, end, hash, n_owners, n_repos, live>>.

    A repository is (owner, ``repo`` column).  ``live``: at most ``max_owners``
    owners hold the value in the whole corpus; otherwise a copied example.
    Texts are read once: a table of spans (no texts) is written and every
    later step works on that.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"),
                      F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                      F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"))
    rows = candidates(src, "_text").withColumn("_words", _words("_text"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "owner", "repo",
                                   "_spans", "_words"), "secret-spans").withColumn("_all", _all_spans())
    found = (rows.where(F.size("_all") > 0)
             .select("_row", "owner", "repo", F.explode("_all").alias("s"))
             .select("_row", "owner", "repo", "s.start", "s.rank", "s.kind", "s.end",
                     F.sha2("s.value", 256).alias("hash")))
    owned = ownership(found.where("kind != 'bare'").select(
        "hash", "owner", F.concat_ws("/", "owner", "repo").alias("repo")))
    rated = (found.join(owned, "hash", "left")
             .withColumn("live", F.coalesce(F.col("n_owners") <= max_owners, F.lit(False)))
             .where("kind != 'bare' OR live"))
    per_row = rated.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
        "start", "rank", "kind", "end", "hash", "n_owners", "n_repos", "live"))).alias("_rated"))
    spans = F.coalesce(F.col("_rated"), F.expr(
        "CAST(array() AS array<struct<start:int,rank:int,kind:string,end:int,hash:string,"
        "n_owners:bigint,n_repos:bigint,live:boolean>>)"))
    return rows.select("_row", "_id").join(per_row, "_row", "left").select(
        F.col("_id").alias(id_col),
        F.filter(spans, lambda s: s["kind"] != "bare").alias("base"),
        F.filter(spans, lambda s: s["kind"] == "bare").alias("added"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, digest of the base spans, all spans as text, and the
    ownership split (n_live, n_example, n_bare) of :func:`scan`'s rows."""
    def line(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(col, test):
        return F.size(F.filter(col, test)).cast("long")

    def of_kind(k):
        return count("base", lambda s: s["kind"] == k).alias(f"n_{k}")

    return scanned.select(
        id_col, *[of_kind(k) for k in KINDS],
        F.sha2(line(F.col("base")), 256).alias("base_sha256"),
        line(F.array_sort(F.concat("base", "added"))).alias("spans"),
        count("base", lambda s: s["live"]).alias("n_live"),
        count("base", lambda s: ~s["live"]).alias("n_example"),
        F.size("added").cast("long").alias("n_bare"))


def mask_live(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source",
              repo: str = "lang", max_owners: int = 1, mask: str = "[credential]") -> DataFrame:
    """``docs`` with the value of every live credential (owner-specific, see
    :func:`scan`) replaced by ``mask``; copied examples and all other text stay.
    Only rows with a candidate meet the ownership table; every row is kept and
    repeated ids are treated row by row."""
    cols = docs.columns
    rows = candidates(docs, text).withColumn("_words", _words(text))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "secret-rows")
    rows = rows.withColumn("_all", _all_spans())
    some, none = rows.where(F.size("_all") > 0), rows.where(F.size("_all") == 0)
    found = some.select("_row", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                        F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"),
                        F.explode("_all").alias("s")).select(
        "_row", "owner", F.concat_ws("/", "owner", "repo").alias("repo"), "s.kind", "s.end",
        (F.col("s.end") - F.length("s.value")).alias("start"), F.sha2("s.value", 256).alias("hash"))
    owned = ownership(found.where("kind != 'bare'")).where(F.col("n_owners") <= max_owners)
    cuts = (found.join(owned.select("hash"), "hash").groupBy("_row")
            .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_cuts")))
    t = F.col(text)
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc, c):
        free = c["start"] >= acc["pos"]
        return F.struct(
            F.greatest(acc["pos"], c["end"]).alias("pos"),
            F.when(free, F.concat(acc["out"], F.substring(t, acc["pos"] + 1, c["start"] - acc["pos"]), F.lit(mask)))
            .otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_cuts", start, step, lambda a: F.concat(
        a["out"], F.substring(t, a["pos"] + 1, F.length(t))))
    some = some.join(cuts, "_row", "left").withColumn(
        text, F.when(F.col("_cuts").isNotNull(), done).otherwise(t))
    return some.select(cols).unionByName(none.select(cols))
