"""Raw tables of different sites brought to one schema: ages, sexes, targets, codes, images and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilens.functions import scalars
from equilens.operators.binning import bin_index

#: Codes of sex, and how labels are numbered.
SEX_LABELS = {"0": "Female", "1": "Male", "2": "Male", "F": "Female", "Female": "Female", "M": "Male", "Male": "Male"}
SEX_NUMBERS = {"Female": 0, "Male": 1}
#: Age groups of the clinical and of the image tables, edges right-closed.
CLINICAL_AGES = ([0, 40, 50, 60, 70, 120], ["<40", "40-49", "50-59", "60-69", "70+"])
IMAGE_AGES = ([0, 20, 40, 60, 80, 120], ["<20", "20-39", "40-59", "60-79", "80+"])
COARSE_AGES = {"<20": "<40", "20-39": "<40", "40-59": "40-59", "60-79": "60+", "80+": "60+"}
#: Diagnoses of the image tables.
DIAGNOSES = {"BCC": 1, "SCC": 1, "MEL": 1, "ACK": 0, "NEV": 0, "SEK": 0}
MOST_YEARS = 120


def mapped(value: Column, mapping: dict) -> Column:
    """The value that `mapping` gives; null for what it lacks."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*pairs)[value] if pairs else F.lit(None)


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def age_group(age: Column, ages: tuple[list, list] = CLINICAL_AGES) -> Column:
    edges, labels = ages
    return F.get(F.array(*map(F.lit, labels)), bin_index(age, edges))


def sex_label(df: DataFrame, column: str, mapping: dict | None = None) -> Column:
    """A label from a number or from text with blanks around it."""
    known = {str(k): v for k, v in (mapping or SEX_LABELS).items()}
    code = F.col(column).cast("long").cast("string") if is_numeric(df, column) else F.trim(F.col(column))
    return mapped(code, known)


def harmonize_schema(df: DataFrame, ages: list[str], sex: str, targets: list[str], most: float = MOST_YEARS) -> DataFrame:
    """Adds age_raw, sex_label, sex_bin and target from the first of the given columns that the table has.

    Ages and targets that are no numbers become null; ages are clipped to 0 and `most`. Text that names no sex stays
    as it is, a number that names none becomes null.
    """
    out = df
    if found := [c for c in ages if c in df.columns]:
        out = out.withColumn("age_raw", scalars.clip(F.col(found[0]).try_cast("double"), 0.0, float(most)))
    if sex in df.columns:
        label = sex_label(df, sex)
        out = out.withColumn("sex_label", label if is_numeric(df, sex) else F.coalesce(label, F.col(sex)))
        out = out.withColumn("sex_bin", mapped(F.col("sex_label"), SEX_NUMBERS))
    if found := [c for c in targets if c in df.columns]:
        out = out.withColumn("target", F.col(found[0]).try_cast("double"))
    return out


def standardize_sensitive(df: DataFrame, age: str, sex: str, ages: tuple[list, list] = CLINICAL_AGES, mapping: dict | None = None) -> DataFrame:
    """Adds age_group, sex_label and sex_bin. A mapping that names no sex of the table gives way to the usual one."""
    if mapping and not df.agg(F.count(sex_label(df, sex, mapping))).first()[0]:
        mapping = None
    out = df.withColumns({"age_group": age_group(F.col(age), ages), "sex_label": sex_label(df, sex, mapping)})
    return out.withColumn("sex_bin", mapped(F.col("sex_label"), SEX_NUMBERS))


def standardize_target(df: DataFrame, column: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Adds target: by `mapping` to no_disease and disease, else as a number; null for what is neither."""
    if not mapping:
        return df.withColumn("target", F.col(column).try_cast("double"))
    return df.withColumn("target", mapped(mapped(F.col(column).cast("string"), mapping), {"no_disease": 0.0, "disease": 1.0}))


def coalesce_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each canonical column takes the first value that isn't null over itself and its aliases, which go."""
    out = df
    for name, others in aliases.items():
        present = [c for c in dict.fromkeys([name, *others]) if c in out.columns]
        if present:
            out = out.withColumn(name, F.coalesce(*present)).drop(*(c for c in present if c != name))
    return out


def value_map_encode(df: DataFrame, column: str, mapping: dict[str, float]) -> DataFrame:
    """Text codes as numbers, null for those that `mapping` lacks; a numeric column stays."""
    return df if is_numeric(df, column) else df.withColumn(column, mapped(F.trim(F.col(column)), mapping))


def unmapped_values(df: DataFrame, column: str, mapping: dict[str, float]) -> DataFrame:
    """(value, n): the codes that `value_map_encode` turns into null."""
    code = F.trim(F.col(column))
    return df.where(F.col(column).isNotNull() & mapped(code, mapping).isNull()).groupBy(code.alias("value")).agg(F.count("*").alias("n"))


def include_exclude_columns(df: DataFrame, include: list[str], exclude: list[str], required: list[str]) -> DataFrame:
    """Keeps what is included or required (all without `include`), then drops what is excluded."""
    kept = [c for c in df.columns if not include or c in {*include, *required}]
    return df.select(*(c for c in kept if c not in exclude))


def _sex_of_images(c: Column) -> Column:
    return F.coalesce(mapped(F.upper(F.trim(c)), {"FEMALE": "Female", "MALE": "Male"}), F.lit("unknown"))


def with_groups(df: DataFrame, sex: str, skin: Column) -> DataFrame:
    """Adds sex_label (unknown), sex (-1 for unknown), fitzpatrick and fitzpatrick_group."""
    label = _sex_of_images(F.col(sex))
    return df.withColumns(
        {
            "sex_label": label,
            "sex": F.coalesce(mapped(label, SEX_NUMBERS), F.lit(-1)),
            "fitzpatrick": F.coalesce(skin.cast("long").cast("string"), F.lit("unknown")),
            "fitzpatrick_group": scalars.skin_group(skin),
        }
    )


def pad_standardize(df: DataFrame, diagnosis: str, age: str, sex: str, skin: str) -> DataFrame:
    """Image metadata with skin_cancer, age_raw, age_group, sex and skin groups; other diagnoses go, unknown groups say so."""
    label = F.upper(F.trim(F.col(diagnosis)))
    known = df.withColumns({"diagnostic_label": label, "skin_cancer": mapped(label, DIAGNOSES)}).where("skin_cancer IS NOT NULL")
    years = F.col(age).try_cast("double")
    aged = known.withColumns({"age_raw": years, "age_group": F.coalesce(age_group(years, IMAGE_AGES), F.lit("unknown"))})
    return with_groups(aged, sex, F.col(skin).try_cast("double"))


def image_presence_filter(df: DataFrame, image: str, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose image is listed, with its path; and one row (found, missing, first_missing) with 50 missing names at most.

    `listing` has (name, path), one row a name. It may be as large as the table, so that both are shuffled.
    """
    found = df.join(listing.select(F.col("name").alias(image), F.col("path").alias("image_path")), image, "left")
    lost = found.where("image_path IS NULL").select(image).orderBy(image).limit(50)
    counts = found.agg(F.count("image_path").alias("found"), F.count_if(F.col("image_path").isNull()).alias("missing"))
    names = lost.agg(F.array_sort(F.collect_list(image)).alias("first_missing"))  # 50 names
    return found.where("image_path IS NOT NULL"), counts.crossJoin(names)


def first_resolvable_path(df: DataFrame, key: str, paths: list[str], listing: DataFrame) -> DataFrame:
    """(key, image_path): the listed path of the first of the path columns whose file name is listed; keys without one are left out."""
    names = F.array(*(scalars.basename(F.col(p)) for p in paths))
    each = df.select(key, F.posexplode(names).alias("_at", "name")).join(listing, "name")
    return each.groupBy(key).agg(F.min_by("path", "_at").alias("image_path"))


def scin_standardize(cases: DataFrame, labels: DataFrame, key: str, weights: str, age: str, sex: str, skin: str, race: str, terms: list[str]) -> DataFrame:
    """Cases with their top-weighted condition, skin_cancer if it holds one of `terms`, and cleaned groups; cases without a condition go."""
    top = scalars.top_weighted_key(F.col(weights))
    labelled = cases.join(labels.select(key, top.alias("diagnostic_label")), key).where("diagnostic_label IS NOT NULL")
    out = labelled.withColumn("skin_cancer", scalars.any_substring(F.col("diagnostic_label"), terms))
    out = out.withColumn("age_group", F.coalesce(F.nullif(scalars.age_token(F.trim(F.col(age))), F.lit("")), F.lit("unknown")))
    return with_groups(out, sex, scalars.fst_numeric(F.col(skin))).withColumn("race_group", scalars.race_group(F.col(race)))


def age_unit_normalize(df: DataFrame, column: str) -> DataFrame:
    """Days as years, two decimals, halves to even."""
    return df.withColumn(column, F.bround(F.col(column) / 365.25, 2))


def missing_policy(df: DataFrame, strategy: str) -> DataFrame:
    """analyze_only and keep leave the table alone, drop_rows drops rows with a null."""
    if strategy not in ("analyze_only", "keep", "drop_rows"):
        raise ValueError(f"unknown strategy {strategy}")
    return df.dropna() if strategy == "drop_rows" else df


def missing_policy_image(df: DataFrame, required: list[str], sensitive: list[str]) -> DataFrame:
    """Rows that lack a required value go; sensitive and other text becomes unknown, other numbers their exact median."""
    kept = df.dropna(subset=required)
    rest = [f for f in df.schema.fields if f.name not in {*required, *sensitive}]
    numeric = [f.name for f in rest if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in rest if isinstance(f.dataType, T.StringType)] + sensitive
    filled = kept.fillna("unknown", subset=text) if text else kept
    if not numeric:
        return filled
    medians = kept.agg(*(F.percentile(c, F.lit(0.5)).alias(f"{c}__m") for c in numeric))
    t = filled.crossJoin(F.broadcast(medians))  # one row
    return t.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}__m")) for c in numeric}).select(*df.columns)


def decode_sensitive(df: DataFrame, column: str, labels: list[str], out: str) -> DataFrame:
    """Scaled codes back to labels: by the order of the distinct values if there are no more than labels, else by equal ranges."""
    n = len(labels)
    seen = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(n + 1).collect()]
    if len(seen) <= n:
        index = mapped(F.col(column), {v: i for i, v in enumerate(sorted(seen))})
    else:
        low, high = df.agg(F.min(column), F.max(column)).first()
        edges = [low + (high - low) * i / n for i in range(n + 1)]
        index = bin_index(F.col(column), edges)
    return df.withColumn(out, F.get(F.array(*map(F.lit, labels)), index))


def decode_groups(c: Column, labels: dict) -> Column:
    """Labels of known codes; all others as text."""
    text = c.cast("string")
    return F.coalesce(mapped(text, {str(k): v for k, v in labels.items()}), text)


def is_unknown_label(c: Column) -> Column:
    """Whether a label, or a part of an intersection, stands for missing data."""
    parts = F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), " x ")
    return F.exists(parts, lambda p: F.trim(p).isin("unknown", "nan", "none", ""))


#: Views of groups: the columns that they are made of. Views of two columns are exploratory.
GROUP_VIEWS = {
    "age_coarse": ("age_coarse",), "sex_view": ("sex_view",), "skin_view": ("skin_view",),
    "sex_x_skin": ("sex_view", "skin_view"), "age_x_skin": ("age_coarse", "skin_view"),
}
SEX_CODES = {"0": "Female", "1": "Male", "-1": "Unknown"}


def derive_group_views(df: DataFrame, age: str = "age_group", sex: str = "sex", skin: str = "fitzpatrick_group") -> DataFrame:
    """Adds the columns of GROUP_VIEWS: coarse age, decoded sex, skin group, and two intersections joined by " x "."""
    text = F.trim(F.col(age).cast("string"))
    coarse = F.when(text.isNull() | F.lower(text).isin("", "nan", "none", "unknown"), "Unknown").otherwise(F.coalesce(mapped(text, COARSE_AGES), text))
    views = df.withColumns({"age_coarse": coarse, "sex_view": decode_groups(F.col(sex), SEX_CODES), "skin_view": F.col(skin).cast("string")})
    return views.withColumns({name: F.concat_ws(" x ", *parts) for name, parts in GROUP_VIEWS.items() if len(parts) > 1})


def resolve_cluster_features(df: DataFrame, target: str, index: str | None = None, engine: list[str] = ()) -> DataFrame:
    """(column, reason): why a column is no feature of clusters; null for features. Integers that are all different are identifiers."""
    whole = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")}
    asked = [c for c in df.columns if c in whole]
    counts = df.agg(F.count("*").alias("_n"), *(F.count_distinct(c).alias(c) for c in asked))

    def reason(c: str) -> Column:
        fixed = "target" if c == target else "engine_output" if c in engine else "index" if c == index else None
        if fixed or not is_numeric(df, c):
            return F.lit(fixed or "non_numeric")
        return F.when((F.col(c) == F.col("_n")) & (F.col("_n") > 1), "identifier") if c in whole else F.lit(None).cast("string")

    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), reason(c).alias("reason")) for c in df.columns))))


def feature_set(columns: list[str], sensitive: list[str], mode: str, ranked: list[str] = (), top: int = 10) -> list[str]:
    """Columns of a mode: exclude_sensitive, include_all, include_<attribute>_only (by prefix), or rfe_top_k of the ranked ones."""
    def belongs(c: str, attr: str) -> bool:
        return c == attr or c.startswith(f"{attr}_")

    if mode == "include_all":
        return list(columns)
    if mode == "rfe_top_k":
        return [c for c in ranked if c in columns][:top]
    only = mode.removeprefix("include_").removesuffix("_only") if mode.startswith("include_") else None
    if only is None and mode != "exclude_sensitive":
        raise ValueError(f"unknown mode {mode}")
    out = [a for a in sensitive if a != only]
    return [c for c in columns if not any(belongs(c, a) for a in out)]


#: How codes of a merged cohort are numbered anew.
THAL = {3: 0, 6: 1, 7: 2}


def cohort_recode(df: DataFrame, less_one: list[str], thal: str, zero_is_null: list[str]) -> DataFrame:
    """Codes that start at 1 start at 0, thal becomes 0 to 2, and zeros that can't be measured become null."""
    changed = {c: F.col(c) - 1 for c in less_one} | {c: F.nullif(F.col(c), F.lit(0)) for c in zero_is_null}
    return df.withColumns(changed | {thal: mapped(F.col(thal).cast("int"), THAL)})


def canonical_key(df: DataFrame, columns: list[str], tenths: list[str]) -> DataFrame:
    """`columns` as they are compared between sources: `tenths` with one decimal, all others as whole numbers; halves to even."""
    return df.select(*(F.bround(c, 1).alias(c) if c in tenths else F.bround(c, 0).cast("long").alias(c) for c in columns))


def sex_label_resolve(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds sex_resolved: the first label that one of the columns gives."""
    found = [sex_label(df, c) for c in columns if c in df.columns]
    return df.withColumn("sex_resolved", reduce(F.coalesce, found, F.lit(None).cast("string")))
