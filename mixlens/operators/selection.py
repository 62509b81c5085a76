"""Choosing rows and models: quotas, rounds, canonical numbering, splits, registries, credentials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from mixlens.functions import text as T
from mixlens.functions import vocabulary as V

PLACEHOLDER_KEY = "local"


def long_enough(text: Column, least: int = 20) -> Column:
    return F.coalesce(F.length(T.strip(text)) >= least, F.lit(False))


#: Cells that a category's first order column is counted in, to find where its quota surely ends.
CELLS = 1024


def _of_category(numbers: dict[str, float], otherwise: float = 0) -> Column:
    """The number of a row's category. A join would work out the category twice."""
    found = F.lit(otherwise)
    for name, n in numbers.items():
        found = F.when(F.col("category").eqNullSafe(name), n).otherwise(found)
    return found


def with_place(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """Add the place of a row in its category, from 1, without a task that holds a category.

    Rows are dealt to ranges of category and order, written down, and counted by range and category; a category's places
    go on in a range where the ranges before it end.
    """
    from mixlens.sources.tables import stored

    spark = rows.sparkSession
    columns = {f"_o{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    part = F.spark_partition_id()
    at = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    dealt = rows.withColumns(columns).repartitionByRange("category", *columns).sortWithinPartitions("category", *columns).withColumns({"_part": part, "_at": at})
    kept = stored(dealt.drop(*columns), "places")
    runs = kept.groupBy("_part", "category").agg(F.min("_at").alias("first"), F.count("*").alias("n")).orderBy("_part").collect()  # no more than ranges and categories
    seen: dict[str, int] = {}
    shifts = []
    for r in runs:
        shifts.append((r._part, r.category, seen.get(r.category, 0) + 1 - r["first"]))
        seen[r.category] = seen.get(r.category, 0) + r.n
    found = spark.createDataFrame(shifts, f"_p int, _c {rows.schema['category'].dataType.simpleString()}, _shift long")
    both = kept.join(found, (F.col("_part") == F.col("_p")) & F.col("category").eqNullSafe(F.col("_c")), "left")
    return both.withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_p", "_c", "_shift")


def first_of_each(rows: DataFrame, most: dict[str, int] | int, order: list[Column | str], name: str = "place") -> DataFrame:
    """The first rows of each category with their place: so many of all, or of those named.

    Where the order starts with a number, its values are counted in cells for each category, and what lies behind the cell
    in which the last wanted row falls goes before anything is sorted; so a sort has little more than the rows wanted.
    """
    from mixlens.sources.tables import stored

    lead = F.col(order[0]) if isinstance(order[0], str) else order[0]
    kept = stored(rows.withColumn("_lead", lead).filter(F.col("category").isin(*most)) if isinstance(most, dict) and most else rows.withColumn("_lead", lead), "quota-rows")
    order = ["_lead", *order[1:]]
    if isinstance(kept.schema["_lead"].dataType, NumericType):
        number = F.col("_lead").cast("double")
        ends = {r.category: r for r in kept.filter(number.isNotNull() & ~F.isnan(number)).groupBy("category").agg(F.min(number).alias("low"), F.max(number).alias("high")).collect()}
        low, high = _of_category({c: r.low for c, r in ends.items()}, 0.0), _of_category({c: r.high for c, r in ends.items()}, 0.0)
        share = F.when(high > low, (number - low) / F.when(high > low, high - low)).otherwise(0.0)
        # null stands first and what is no number last, as Spark sorts them
        cell = F.when(number.isNull(), -1).when(F.isnan(number), CELLS).otherwise(F.least(F.floor(share * CELLS).cast("int"), F.lit(CELLS - 1)))
        wanted: dict[str, int] = {}
        seen: dict[str, int] = {}
        for r in kept.groupBy("category", cell.alias("cell")).agg(F.count("*").alias("n")).orderBy("category", "cell").collect():  # CELLS rows a category
            need = most.get(r.category, 0) if isinstance(most, dict) else most
            if seen.get(r.category, 0) < need:
                wanted[r.category] = r.cell
                seen[r.category] = seen.get(r.category, 0) + r.n
        kept = kept.filter(cell <= _of_category(wanted, -2))
    placed = with_place(kept, order, name).drop("_lead")
    return placed.filter(F.col(name) <= (_of_category(most) if isinstance(most, dict) else most))


def quota_sample(rows: DataFrame, targets: DataFrame, order: list[Column | str]) -> DataFrame:
    """The first rows of each category up to its target; other categories go. targets has a row for each category."""
    return first_of_each(rows, {r.category: r.target for r in targets.select("category", "target").collect()}, order)


def round_slice(rows: DataFrame, order: list[Column | str], needed: int, cursor: int = 0, first: bool = True) -> DataFrame:
    """The next candidates of each category: a quarter more than needed in the first round, exact afterwards."""
    take = int(needed * 1.25) if first else needed
    return first_of_each(rows, cursor + take, order).filter(F.col("place") > cursor)


def between_places(placed: DataFrame, low: dict[str, int], high: dict[str, int]) -> DataFrame:
    """Rows with a place above low and up to high of their category; the bounds reach the scan of a stored table."""
    wanted = F.lit(False)
    for name, upto in high.items():
        wanted = wanted | ((F.col("category") == name) & (F.col("place") > low.get(name, 0)) & (F.col("place") <= upto))
    return placed.filter(wanted)


def sample_rows(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by a hash of the key, as a small report shows them; all if there are fewer."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def global_places(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Add the place from 0 in the total order, without one task that holds all rows.

    Rows are dealt to ranges and sorted there; the places of a range begin after the sizes of the ranges before it. The
    ranges are written down first, so that both passes see the same.
    """
    from mixlens.sources.tables import stored

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    kept = stored(dealt, "places")
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def finalize_ids(rows: DataFrame, prefix: str = "item_") -> DataFrame:
    """Number rows from 0 in the order of category and instruction: ids with five digits at least."""
    placed = global_places(rows, ["category", "original_instruction"])
    digits = F.lpad(F.col("place").cast("string"), F.greatest(F.lit(5), F.length(F.col("place").cast("string"))), F.lit("0"))
    return placed.withColumn("id", F.concat(F.lit(prefix), digits)).drop("place")


def train_test(rows: DataFrame, order: list[str], share: float = 0.9) -> DataFrame:
    """Add split: train for the first share of the rows, cut down to whole rows, else test."""
    placed = global_places(rows, order)
    total = rows.count()
    return placed.withColumn("split", F.when(F.col("place") < int(share * total), "train").otherwise("test")).drop("place")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key)


def parse_model(spec: Column) -> tuple[Column, Column]:
    """name and model_id of ``name=model_id``; without ``=`` both are the whole."""
    trimmed = T.strip(spec)
    name = F.substring_index(trimmed, "=", 1)
    model = F.when(F.contains(trimmed, F.lit("=")), F.expr("substring(_s, instr(_s, '=') + 1)")).otherwise("")
    return name, F.when(model == "", name).otherwise(model)


def select_models(models: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None, add: Sequence[str] | None = None) -> DataFrame:
    """Append given models, keep only the included, drop the excluded; by name or model_id. Unknown tokens raise."""
    spark = models.sparkSession
    found = models
    if specs := [s for s in add or [] if s.strip()]:
        rows = spark.createDataFrame([(s.strip(),) for s in specs], "_s string")
        name, model = parse_model(F.col("_s"))
        found = found.unionByName(rows.select(name.alias("name"), model.alias("model_id")), allowMissingColumns=True)
    for tokens, keep in ((include, True), (exclude, False)):
        if tokens:
            hit = F.col("name").isin(*tokens) | F.col("model_id").isin(*tokens)
            met = F.explode(F.array_intersect(F.array("name", "model_id"), F.array(*map(F.lit, tokens))))
            known = {r.token for r in found.filter(hit).select(met.alias("token")).distinct().collect()}  # no more than tokens
            if missing := [t for t in tokens if t not in known]:
                raise ValueError(f"no model matches {missing}")
            found = found.filter(hit if keep else ~hit)
    if found.isEmpty():
        raise ValueError("no models are left")
    return found


def url_host(url: Column) -> Column:
    """Lower-cased host without user and port, as URL libraries read it."""
    authority = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(bare, r"^[^:]*", 0)))


def is_local_url(url: Column) -> Column:
    return F.coalesce(url_host(url).isin(*V.LOCAL_HOSTS), F.lit(False))


def is_local(url: str) -> bool:
    from urllib.parse import urlsplit

    return (urlsplit(url).hostname or "").lower() in V.LOCAL_HOSTS


def credential_source(base_url: Column, key_name: Column, key: Column, default_url: str) -> Column:
    """Where a model's key comes from: env, local, default; refused if the default key would go to another host."""
    url = F.coalesce(F.when(base_url != "", base_url), F.lit(default_url))
    local = is_local_url(url)
    named = F.coalesce(key_name, F.lit("")) != ""
    has_key = F.coalesce(key, F.lit("")) != ""
    same = F.rtrim(url, F.lit("/")) == default_url.rstrip("/")
    return F.when(named & has_key, "env").when(named & local, "local_unset").when(named, "env_unset").when(local, "local").when(same, "default").otherwise("refused")


def resolve_credentials(model: dict, default_url: str, default_key: str, environment: dict[str, str]) -> tuple[str, str, str]:
    """Endpoint, key and where the key is from, for one model. The default key goes to the default endpoint alone."""
    url, name = model.get("base_url") or default_url, model.get("api_key_env")
    local = is_local(url)
    if name:
        key = environment.get(name, "")
        return (url, PLACEHOLDER_KEY, f"{name} (unset)") if local and not key else (url, key, name)
    if local:
        return url, PLACEHOLDER_KEY, "local"
    if url.rstrip("/") != default_url.rstrip("/"):
        raise ValueError(f"{url} needs a key of its own")
    return url, default_key, "default"
