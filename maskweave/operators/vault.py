"""The vault (value ↔ token per scope) and token allocation.

Vault rows: ``scope, value, token, template, family, idx, batch_id, ord`` where
``(batch_id, ord)`` is the insertion order.  Counters: ``scope, template, n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.tokens import canonical_family, canonical_of, family_col, format_token, overlapping_formats, token_number
from maskweave.operators.joins import two_level_rank
from maskweave.operators.tables import written

VAULT_SCHEMA = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("template", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("ord", T.ArrayType(T.LongType())),
    ]
)
COUNTER_SCHEMA = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("template", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def empty_vault(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VAULT_SCHEMA)


def empty_counters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COUNTER_SCHEMA)


def first_occurrences(occ: DataFrame) -> DataFrame:
    """occ(scope, value, template, ord) → one row per (scope, value) at its first use.

    A partial (map-side) aggregate: a value seen in a third of all rows is
    combined inside each task before the shuffle.
    """
    return occ.groupBy("scope", "value").agg(
        F.min("ord").alias("ord"), F.min_by("template", "ord").alias("template")
    )


def _numbered(new: DataFrame, taken: DataFrame | None, start: DataFrame) -> DataFrame:
    """``new`` (scope, class, ord, value, ...) with ``idx``: consecutive numbers of each (scope, class) in order,
    from above ``start`` (scope, class, c), leaving out the numbers of ``taken`` (scope, class, t)."""
    key = ["scope", "class"]
    ranked = two_level_rank(new.withColumn("_by", F.struct("ord", "value")), key, "_by", out="r").drop("_by")
    ranked = ranked.join(start, key, "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))
    if taken is None:
        return ranked.withColumn("idx", F.col("c") + F.col("r")).drop("r", "c")
    above = taken.join(start, key, "left").filter(F.col("t") > F.coalesce("c", F.lit(0))).select(*key, "t", F.coalesce("c", F.lit(0)).alias("c"))
    above = written(above.distinct(), "taken-numbers")
    if above.isEmpty():
        return ranked.withColumn("idx", F.col("c") + F.col("r")).drop("r", "c")
    # the j-th number taken stands before the new value of rank t - c - j + 1: rank values and taken numbers together
    holes = two_level_rank(above, key, "t", out="j").select(*key, (F.col("t") - F.col("c") - F.col("j") + 1).alias("r"), F.lit(0).alias("kind"), F.col("t").alias("tie"))
    rows = ranked.withColumn("kind", F.lit(1)).withColumn("tie", F.lit(0).cast("long"))
    both = rows.unionByName(holes, allowMissingColumns=True).withColumn("_by", F.struct("r", "kind", "tie"))
    both = two_level_rank(both, key, "_by", out="total").filter("kind = 1")
    return both.withColumn("idx", F.col("c") + F.col("total")).drop("r", "c", "kind", "tie", "_by", "total")


def allocate_tokens(
    occ: DataFrame,
    vault: DataFrame | None,
    counters: DataFrame,
    families: list[str],
    batch_id: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """C4: tokens for all values of ``occ`` not yet in ``vault``.

    Values are numbered within their class in first-occurrence order, continuing
    from the stored counters and skipping numbers whose token is already taken.
    A class is the formats that print the same token for the same number (a label and
    ``label_{index}``): they share numbers, but a label's first value is the bare label.
    Formats that may print the same token for different numbers (``A{index}`` and
    ``A1{index}``) are numbered apart; then every token that is held twice goes on to the
    next free numbers, until none is.  So (scope, token) is unique, forced tokens included.
    Returns (new vault rows, new counters).
    """
    key = ["scope", "class"]
    new = first_occurrences(occ)
    prior = vault
    if prior is None:
        vault = empty_vault(occ.sparkSession)
    else:
        new = new.join(vault.select("scope", "value"), ["scope", "value"], "left_anti")
    new = written(new.withColumn("family", family_col(F.col("template"))).withColumn("class", canonical_family(F.col("family"))), "new-values")

    stored = counters.withColumn("family", family_col(F.col("template"))).withColumn("class", canonical_family(F.col("family")))
    start = stored.groupBy(*key).agg(F.max("n").alias("c"))

    # numbers that tokens in the vault hold, as each class reads them
    classes = sorted({canonical_of(f) for f in families})
    read = F.array(*[F.struct(F.lit(c).alias("class"), token_number(c, F.col("token")).alias("t")) for c in classes]) if classes else F.array().cast("array<struct<class:string,t:bigint>>")
    taken = vault.select("scope", F.explode(F.filter(read, lambda x: x["t"].isNotNull())).alias("x")).select("scope", "x.class", "x.t")

    labels = [f for f in families if f.startswith("L:")]
    if labels:
        firsts = _unnumbered(new, stored, vault, taken, shared={canonical_of(f) for f in labels} & {f for f in families if not f.startswith("L:")})
        new = written(new.join(firsts, ["scope", "value"], "left"), "new-values")
        # where a class has labels, its other values are numbered from 2
        least = new.filter(F.col("family").startswith("L:")).select(*key, F.lit(1).cast("long").alias("c"))
        start = start.unionByName(least).groupBy(*key).agg(F.max("c").alias("c"))
        first = new.filter(F.col("token").isNotNull()).withColumn("idx", F.lit(1).cast("long"))
        new = new.filter(F.col("token").isNull()).drop("token")
    rows = _numbered(new, None if prior is None else taken, start)
    rows = rows.withColumn("token", format_token(F.col("class"), F.col("idx")))
    if labels:
        rows = rows.unionByName(first)

    if overlapping_formats(families):
        rows = _unique(written(rows, "tokens"), vault)
    new_rows = rows.select("scope", "value", "token", "template", "family", "idx", F.lit(batch_id).cast("long").alias("batch_id"), "ord")
    new_counters = (
        new_rows.groupBy("scope", "template")
        .agg(F.max("idx").alias("n"))
        .unionByName(counters)
        .groupBy("scope", "template")
        .agg(F.max("n").alias("n"))
    )
    return new_rows, new_counters


def _unnumbered(new: DataFrame, stored: DataFrame, vault: DataFrame, taken: DataFrame, shared: set[str]) -> DataFrame:
    """(scope, value, token) of the values that take no number of their class: a label's first value is the bare
    label, and the first value of ``label_{index}`` is ``label_1``, which labels never print."""
    is_label = F.col("family").startswith("L:")
    one = F.min(F.struct("ord", "value"))["value"].alias("value")
    bare = new.filter(is_label).groupBy("scope", "family").agg(one).join(stored.select("scope", "family"), ["scope", "family"], "left_anti")
    bare = bare.select("scope", "value", F.substring(F.col("family"), 3, 1 << 30).alias("token"))
    bare = bare.join(vault.select("scope", "token"), ["scope", "token"], "left_anti")
    if not shared:
        return bare.select("scope", "value", "token")
    numbered = new.filter(~is_label & F.col("class").isin(*shared)).groupBy("scope", "class").agg(one)
    numbered = numbered.join(stored.filter(~is_label).select("scope", "class"), ["scope", "class"], "left_anti")
    numbered = numbered.join(taken.filter("t = 1").select("scope", "class"), ["scope", "class"], "left_anti")
    return bare.select("scope", "value", "token").unionByName(numbered.select("scope", "value", format_token(F.col("class"), F.lit(1)).alias("token")))


def _unique(rows: DataFrame, vault: DataFrame) -> DataFrame:
    """``rows`` with tokens that are held twice moved to numbers above their class's, round by round."""
    while True:
        held = rows.select("scope", "token", F.struct(F.lit(1).alias("new"), "ord", "value").alias("who"))
        held = held.unionByName(vault.select("scope", "token", F.struct(F.lit(0).alias("new"), F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"), "value").alias("who")))
        keeps = held.groupBy("scope", "token").agg(F.min("who").alias("who"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        twice = rows.join(keeps, ["scope", "token"]).filter((F.col("who.new") == 0) | (F.col("who.value") != F.col("value"))).drop("who", "n")
        twice = written(twice, "tokens-twice")
        if twice.isEmpty():
            return rows
        key = ["scope", "class"]
        top = rows.groupBy(*key).agg(F.max("idx").alias("c"))
        moved = _numbered(twice.drop("idx", "token"), None, top).withColumn("token", format_token(F.col("class"), F.col("idx")))
        rows = written(rows.join(twice.select("scope", "value"), ["scope", "value"], "left_anti").unionByName(moved.select(*rows.columns)), "tokens")


def vault_list(vault: DataFrame) -> DataFrame:
    """All pairs in insertion order (ordering applied by the caller's sort)."""
    return vault.select("scope", "value", "token", "batch_id", "ord").orderBy("scope", "batch_id", "ord")


def vault_lookup(tokens: DataFrame, vault: DataFrame, token_col: str = "token") -> DataFrame:
    """Token → value (null when unknown)."""
    v = vault.select("scope", F.col("token").alias(token_col), F.col("value").alias("original"))
    return tokens.join(v, ["scope", token_col], "left")


def active_tokens(vault: DataFrame) -> DataFrame:
    """Per scope, the distinct tokens in insertion order joined by ', '."""
    firsts = vault.groupBy("scope", "token").agg(F.min(F.struct("batch_id", "ord")).alias("o"))
    return firsts.groupBy("scope").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("o", "token"))), lambda x: x["token"]), ", "
        ).alias("token_list"),
        F.count(F.lit(1)).alias("n_tokens"),
    )


def store_mappings(vault: DataFrame, overrides: DataFrame, batch_id: int = 0) -> DataFrame:
    """Force value → token.  The last override per (scope, value) wins (by
    ``seq``); the value's old token stops resolving; a token forced onto a new
    value no longer resolves to its old value either."""
    w = Window.partitionBy("scope", "value").orderBy(F.col("seq").desc())
    last = (
        overrides.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
        .select("scope", "value", F.col("token").alias("new_token"), "seq")
    )
    kept = vault.join(last.select("scope", "value"), ["scope", "value"], "left_anti")
    kept = kept.join(last.select("scope", F.col("new_token").alias("token")), ["scope", "token"], "left_anti")
    forced = last.select(
        "scope",
        "value",
        F.col("new_token").alias("token"),
        F.lit(None).cast("string").alias("template"),
        F.lit(None).cast("string").alias("family"),
        F.lit(None).cast("long").alias("idx"),
        F.lit(batch_id).cast("long").alias("batch_id"),
        F.array(F.col("seq").cast("long")).alias("ord"),
    )
    return kept.unionByName(forced)


def clear_scope(vault: DataFrame, counters: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """C11: drop the pairs and the counters of one scope."""
    return vault.filter(F.col("scope") != scope), counters.filter(F.col("scope") != scope)


class VaultLog:
    """The vault as an append-only log in shared storage.

    A version (a batch id) adds one folder with its new pairs and counters, so the cost of a batch is
    its own; writing a version again replaces it.  A version counts once the job of its last
    folder has left a ``_SUCCESS`` mark, so a half-written one is never read.  Pairs are dealt to ``buckets`` folders by
    their scope's hash, whatever the number of scopes.  ``compact`` writes all versions up to one into a
    base; readers start at the newest base.  ``drop`` and ``clear`` are recorded like pairs.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _target(self, part: str, kind: str, version: int) -> str:
        return f"{self.path}/{part}/kind={kind}/version={version}"

    def _folders(self, kind: str) -> list[int]:
        """Versions of ``kind`` (delta or base) that are whole, found in storage; the counters are written last."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/counters/kind={kind}")
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        paths = [st.getPath() for st in fs.listStatus(root) if st.isDirectory()]
        return sorted(int(p.getName().split("=")[1]) for p in paths if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def versions(self) -> list[int]:
        return sorted({*self._folders("delta"), *self._folders("base")})

    def _write(self, kind: str, version: int, pairs: DataFrame, counters: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("scope"), F.lit(self.buckets)).cast("int").alias("bucket")
        pairs.select(*VAULT_SCHEMA.fieldNames(), "gone", bucket).write.mode("overwrite").partitionBy("bucket").parquet(self._target("pairs", kind, version))
        counters.select(*COUNTER_SCHEMA.fieldNames()).write.mode("overwrite").parquet(self._target("counters", kind, version))

    def _read(self, part: str, schema: T.StructType, chosen: list[tuple[str, int]]) -> DataFrame:
        folders = T.StructType([*schema.fields, T.StructField("kind", T.StringType()), T.StructField("version", T.LongType())])
        reader = self.spark.read.schema(folders).option("basePath", f"{self.path}/{part}")
        return reader.parquet(*[self._target(part, *c) for c in chosen])

    def append(self, version: int, pairs: DataFrame, counters: DataFrame, dropped: DataFrame | None = None, cleared: DataFrame | None = None) -> None:
        """Record ``pairs`` and ``counters`` (new or changed ones), ``dropped`` (scope, value) and ``cleared`` (scope)."""
        rows = pairs.select(*VAULT_SCHEMA.fieldNames()).withColumn("gone", F.lit(False))
        for gone in (dropped, cleared):
            if gone is not None:
                rows = rows.unionByName(gone.withColumn("gone", F.lit(True)), allowMissingColumns=True)
        self._write("delta", version, rows, counters)

    def load(self, before: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(pairs, counters) of all versions, or of those below ``before``."""
        ok = lambda v: before is None or v < before
        bases = [v for v in self._folders("base") if ok(v)]
        base = bases[-1] if bases else None
        chosen = [("delta", v) for v in self._folders("delta") if ok(v) and (base is None or v > base)]
        if base is not None:
            chosen.insert(0, ("base", base))
        if not chosen:
            return empty_vault(self.spark), empty_counters(self.spark)
        schema = T.StructType([*VAULT_SCHEMA.fields, T.StructField("gone", T.BooleanType())])
        log = self._read("pairs", schema, chosen)
        counts = self._read("counters", COUNTER_SCHEMA, chosen)
        clear = log.filter(F.col("gone") & F.col("value").isNull()).groupBy("scope").agg(F.max("version").alias("cleared"))
        log = log.filter(F.col("value").isNotNull()).join(clear, "scope", "left").filter(F.col("cleared").isNull() | (F.col("version") > F.col("cleared")))
        row = F.struct(*VAULT_SCHEMA.fieldNames()[2:], "gone")
        # the newest entry of a value counts; a value that is dropped and put in one version stays
        newest = log.groupBy("scope", "value").agg(F.max_by(row, F.struct("version", ~F.col("gone"))).alias("row"))
        pairs = newest.select("scope", "value", "row.*").filter(~F.col("gone")).select(*VAULT_SCHEMA.fieldNames())
        counts = counts.join(clear, "scope", "left").filter(F.col("cleared").isNull() | (F.col("version") > F.col("cleared")))
        return pairs, counts.groupBy("scope", "template").agg(F.max("n").alias("n"))

    def compact(self, version: int | None = None) -> None:
        """Write all versions up to ``version`` (the newest) into a base; older folders are no longer read."""
        version = self.versions()[-1] if version is None else version
        pairs, counters = self.load(version + 1)
        self._write("base", version, pairs.withColumn("gone", F.lit(False)), counters)


def save_vault(vault: DataFrame, counters: DataFrame, path: str, batch_id: int) -> str:
    """Record ``vault`` as one version of the log at ``path`` (again, if it is there)."""
    VaultLog(vault.sparkSession, path).append(batch_id, vault, counters)
    return path


def load_vault(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read the log back (the reverse map is the same table read by token)."""
    return VaultLog(spark, path).load()
