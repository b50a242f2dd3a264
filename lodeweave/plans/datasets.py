"""What is done with hits: questions by keyword arguments or by column, the hit's table, its join (O-03, O-05, O-07 to O-09, Q-03, S-21, B-10, K-04)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.operators import catalog as store
from lodeweave.operators import joins, profile, search
from lodeweave.sources import readers

#: Fixed value: datasets listed for each column.
BEST = 10


def query(catalog: DataFrame, terms: DataFrame | None = None, ratio: float | None = None, query_string: str | None = None, start: str | None = None, end: str | None = None, dataset_id: int | None = None, variable_id: int | None = None, key_values: Sequence[tuple[str, object]] | None = None) -> DataFrame:
    """O-03: descriptions that meet all that is given; without any argument all of them.

    terms (term): texts of which the share ``ratio`` must be named by one variable; its number of hits and 1 is
    the ``score``, which is 1 where no terms are given.
    """
    conditions = [
        search.any_field(query_string) if query_string else None,
        search.temporal(start, end) if start or end else None,
        search.by_id(dataset_id) if dataset_id is not None else None,
        search.by_variable_id(variable_id) if variable_id is not None else None,
        search.key_values(key_values) if key_values else None,
    ]
    kept = catalog.where(search.all_of(*conditions))
    if terms is None:
        return kept.withColumn("score", F.lit(1.0))
    hits = search.terms_hits(search.postings(kept), terms, ratio)
    return kept.join(hits.groupBy("dataset_id").agg((F.max("n_terms") + 1).cast("double").alias("score")), "dataset_id")


def search_columns(catalog: DataFrame, data: DataFrame, ratio: float | None = None, query_string: str | None = None, best: int = BEST, columns: Sequence[str] | None = None) -> DataFrame:
    """O-05: (column_idx, dataset_id, n_terms, rank): for each able column the best datasets, by terms matched, ties to smaller ids.

    All columns are asked in one plan; ``columns`` names them where it is known which are able.
    """
    able = [r["column"] for r in profile.entity_columns(data).collect() if r["is_entity"]] if columns is None else list(columns)
    kept = catalog.where(search.any_field(query_string)) if query_string else catalog
    place = {c: i for i, c in enumerate(data.columns)}
    out = "column_idx int, dataset_id bigint, n_terms bigint, rank int"
    if not able:
        return data.sparkSession.createDataFrame([], out)
    cells = F.explode(F.array(*(F.struct(F.lit(place[c]).alias("column_idx"), F.col(f"`{c}`").cast("string").alias("term")) for c in able)))
    terms = data.select(cells.alias("c")).select("c.*")
    hits = search.terms_hits(search.postings(kept), terms, ratio, by=("column_idx",))
    of = hits.groupBy("column_idx", "dataset_id").agg(F.max("n_terms").alias("n_terms"))
    # hits are at most a catalog's datasets a column; the rank's sort is Spark's, with its group limit ahead of the shuffle
    rank = F.row_number().over(Window.partitionBy("column_idx").orderBy(F.desc("n_terms"), "dataset_id"))
    return of.withColumn("rank", rank).where(F.col("rank") <= best)


def described(catalog: DataFrame, dataset_id: int) -> dict:
    """S-21, B-10: one description; an unknown id raises KeyError."""
    row = catalog.where(search.by_id(dataset_id)).first()
    if row is None:
        raise KeyError(f"no dataset {dataset_id}")
    return row.asDict(recursive=True)


def load_by_id(catalog: DataFrame, dataset_id: int, head: int | None = None, constraints: dict | None = None) -> DataFrame:
    """S-21: a dataset of the catalog, or its first rows."""
    df = readers.load(catalog.sparkSession, described(catalog, dataset_id), constraints)
    return df if head is None else df.limit(head)


def cached(spark: SparkSession, description: dict, folder: str) -> DataFrame:
    """K-04: the described dataset as Parquet under the folder, by its id; loaded and written only if it isn't there whole yet."""
    path = f"{folder.rstrip('/')}/{int(description['dataset_id'])}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        readers.load(spark, description).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def entity_constraints(hits: DataFrame) -> DataFrame:
    """Q-03: (dataset_id, offset, values): what constrains a dataset's columns, from the hits of ``search.terms_hits``."""
    return hits.groupBy("dataset_id", "offset").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"))


def join_indices(left: DataFrame, variables: Sequence[dict], left_columns: Sequence[Sequence[int | str]], right_columns: Sequence[Sequence[int | str]]) -> tuple[list[list[int]], list[list[int]]]:
    """O-07: join columns as positions; names are looked up in the table and among the variables. Unequal numbers of them raise ValueError."""
    if len(left_columns) != len(right_columns):
        raise ValueError("as many join columns are needed on either side")
    at = lambda names, groups: [[names.index(x) if isinstance(x, str) else x for x in g] for g in groups]
    return at(left.columns, left_columns), at([v.get("name") for v in variables], right_columns)


def summary(hit: dict, left_columns: Sequence = (), right_columns: Sequence = ()) -> str:
    """O-08: a hit for reading: its columns with three entities each, of ten or more the outer five, and the columns to join by."""
    variables = list(enumerate(hit.get("variables") or []))
    line = lambda i, v: f"\n\t[{i}] {v.get('name') or ''} " + (f"({', '.join(v['named_entity'][:3])} ...)" if v.get("named_entity") else "")
    shown = [line(i, v) for i, v in variables]
    if len(shown) >= 10:
        shown = [*shown[:5], "\n\t ... ", *shown[-5:]]
    pairs = [f"{x!s:>20} <-> {y!s:<20}" for x, y in zip(left_columns, right_columns)] if len(left_columns) == len(right_columns) else []
    by = "\n\t".join([f"\n\t{'Original Columns':>20} <-> {'Dataset Columns':<20}", *pairs]) if pairs else "None"
    facts = {"Dataset ID": hit.get("dataset_id"), "Score": hit.get("score"), "Description": hit.get("description") or "", "URL": hit.get("url") or "", "Columns": "".join(shown), "Recommend Join Columns": by}
    return f" - {hit.get('title') or ''} -\n" + "\n".join(f"    * {k}: {v}" for k, v in facts.items())


def constrained_join(left: DataFrame, description: dict, values: dict[int, Sequence[str]], left_columns: Sequence[int], right_columns: Sequence[int], constraints: dict | None = None) -> DataFrame:
    """O-09: the left table joined to a dataset of which only rows are read that can meet it.

    values: of the dataset's columns the entities that the search matched (Q-03); the range of dates is
    that of the left table's first column of dates. Both become filters of the dataset's source.
    """
    if not values:
        raise ValueError("a join follows a search: no matches are given")
    asked = dict(constraints or {}) | {"named_entity": values}
    kinds = dict(left.dtypes)
    dated = [c for c in left.columns if kinds[c] in ("string", "timestamp", "timestamp_ntz", "date")]
    found = {r["column"]: r for r in profile.temporal_coverage(left, dated).collect()} if dated else {}
    first = next((found[c] for c in dated if c in found and found[c]["start"] and found[c]["end"]), None)
    if first is not None:
        asked["date_range"] = {"start": first["start"], "end": first["end"]}
    right = readers.load(left.sparkSession, description, asked)
    return joins.equi_left_join(left, right, [left.columns[i] for i in left_columns], [right.columns[i] for i in right_columns])
