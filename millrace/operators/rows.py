"""Row-wise operators: projection, gates, branches. Each takes and returns DataFrames or Columns; nothing is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def passthrough(df: DataFrame) -> DataFrame:
    return df


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns under their new names; others unchanged."""
    return df.withColumnsRenamed(mapping)


def merge(df: DataFrame, columns: list[str], out: str = "merged") -> DataFrame:
    """Adds one struct of the columns, fields in name order."""
    return df.withColumn(out, F.struct(*sorted(columns)))


def split_struct(df: DataFrame, column: str) -> DataFrame:
    """One column for each field of a struct."""
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")


def split_array(df: DataFrame, column: str, n: int) -> DataFrame:
    """item_0 .. item_{n-1} of an array; null beyond its end."""
    return df.select(*[c for c in df.columns if c != column], *[F.get(column, F.lit(i)).alias(f"item_{i}") for i in range(n)])


def truthy(value: Column, null_word: bool = False) -> Column:
    """Whether a text counts as true: not null, '', 'false' or '0' (in guards not 'null' either)."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return ~text.isin("", "false", "0", *(["null"] if null_word else []))


def gate(df: DataFrame, guard: Column) -> DataFrame:
    """Rows whose guard is true; null counts as closed."""
    return df.where(F.coalesce(guard, F.lit(False)))


def equals_guard(column: Column, word: str, negate: bool = False) -> Column:
    """The bare comparison ``column == word`` on texts; a null is the empty text."""
    same = F.coalesce(column.cast("string"), F.lit("")) == F.lit(word)
    return ~same if negate else same


def decide(df: DataFrame, label: Column, out: str = "_decision") -> DataFrame:
    """Adds the branch label, by the guard's type: booleans become yes and no, whole numbers yes unless 0, texts are
    labels as they are, anything else that is not null yes; null is no."""
    kind = df.select(label).schema[0].dataType
    if isinstance(kind, T.StringType):
        word = label
    else:
        true = label if isinstance(kind, T.BooleanType) else label != 0 if isinstance(kind, T.IntegralType) else label.isNotNull()
        word = F.when(true, "yes")
    return df.withColumn(out, F.coalesce(word, F.lit("no")))


def model_guard(answer: Column, fallback: Column) -> Column:
    """A model's answer as a guard: yes/true and no/false, other words as labels; without an answer the fallback's label (a text) decides."""
    word = F.lower(F.trim(answer))
    said = F.when(word.isin("yes", "true"), "yes").when(word.isin("no", "false"), "no").when(word != "", F.trim(answer))
    return F.coalesce(said, fallback)


def branch(df: DataFrame, labels: list[str], decision: str = "_decision") -> dict[str, DataFrame]:
    """One DataFrame for each edge label; ``else`` gets the rows that no other label takes."""
    named = [x for x in labels if x != "else"]
    out = {x: df.where(F.col(decision) == x) for x in named}
    if "else" in labels:
        out["else"] = df.where(~F.col(decision).isin(named)) if named else df
    return out


def branch_columns(df: DataFrame, label: Column, cases: dict[str, dict[str, Column]]) -> DataFrame:
    """Branches that only add columns, converged again: one scan for all labels. ``else`` takes the other labels; rows that no case takes go,
    and a column that a case lacks is null there."""
    d = decide(df, label)
    named = [k for k in cases if k != "else"]
    takes = {k: F.col("_decision") == k for k in named} | ({"else": ~F.col("_decision").isin(named) if named else F.lit(True)} if "else" in cases else {})
    kept = d if "else" in cases else d.where(F.col("_decision").isin(named))
    names = dict.fromkeys(n for columns in cases.values() for n in columns)
    made = {n: F.coalesce(*[F.when(takes[k], columns[n]) for k, columns in cases.items() if n in columns]) for n in names}
    return kept.withColumns(made).drop("_decision")


def converge(parts: list[DataFrame]) -> DataFrame:
    """The rows of disjoint branches together; missing columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fan_in(parts: list[DataFrame], token: str) -> DataFrame:
    """Outputs of several predecessors for the same token side by side; of columns that clash the later part's value wins."""
    out = parts[0]
    for p in parts[1:]:
        clash = [c for c in p.columns if c != token and c in out.columns]
        right = p.withColumnsRenamed({c: f"__{c}" for c in clash})
        out = out.join(right, token, "full_outer").withColumns({c: F.coalesce(f"__{c}", c) for c in clash}).drop(*[f"__{c}" for c in clash])
    return out


def keys_of(items: Column, key: str) -> Column:
    """The field of each struct in an array."""
    return F.transform(items, lambda x: x.getField(key))


def route_first_match(text: Column, routes: list[tuple[str, str]], default: str) -> Column:
    """The answer of the first route whose word the text contains."""
    out = None
    for word, answer in routes:
        hit = F.contains(text, F.lit(word))
        out = F.when(hit, answer) if out is None else out.when(hit, answer)
    return F.lit(default) if out is None else out.otherwise(default)


def observed(df: DataFrame, name: str) -> DataFrame:
    """df, counting its rows as a metric of that name on the way."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


def error_transform(df: DataFrame, transform: str, node: str = "", field_map: dict[str, str] | None = None) -> DataFrame:
    """simplify: error is the error_type alone, error_type and recoverable go. enrich: adds _error_node. Then columns are renamed."""
    out = df
    if transform == "simplify":
        out = df.drop("error")
        out = out.withColumnRenamed("error_type", "error").drop("recoverable")
    elif transform == "enrich":
        out = df.withColumn("_error_node", F.lit(node))
    return out.withColumnsRenamed(field_map or {})


def select_path(views: dict[str, Column], path: str, keys: str | None = None, join: str | None = None) -> Column:
    """The value at a dotted path as JSON text (texts bare): the first segment names a view (inputs, results, constants: JSON texts), or
    output_dir, a text. keys takes that field of each object of an array, texts only, as a JSON array or joined.
    What does not resolve is the path itself."""
    root, _, rest = path.partition(".")
    if root not in views:
        return F.lit(path)
    if root == "output_dir":
        return F.coalesce(views[root], F.lit(path))
    steps = "".join(f"[{x}]" if x.isdigit() else f"['{x}']" for x in rest.split(".") if x)
    found = F.get_json_object(views[root], f"${steps}")
    if keys is not None:
        value = lambda x: F.variant_get(F.try_parse_json(x), f"$.{keys}", "variant")
        items = F.filter(F.from_json(found, "array<string>"), lambda x: F.coalesce(F.schema_of_variant(value(x)) == "STRING", F.lit(False)))
        texts = F.transform(items, lambda x: F.get_json_object(x, f"$.{keys}"))
        projected = F.array_join(texts, join) if join is not None else F.to_json(texts)
        found = F.when(found.startswith("["), projected).otherwise(found)
    return F.coalesce(found, F.lit(path))
