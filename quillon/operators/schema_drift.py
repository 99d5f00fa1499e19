"""Drifting JSON files into one steady table, with a list of the changes between files.

Rescue-column ingestion: every top-level field of a file that maps to a field of the target schema
and can be cast goes into its typed column; every other field, and every value that can't be cast,
is kept as JSON in ``rescued``. ``promote`` adds approved fields to the target and replays the
rescued values of files read earlier into the new typed columns. ``changes`` compares the fields of
each ingested file with those of the one before it in its series.

Names are matched by measure: camel and snake case, word order and the shortenings listed under
``ALIASES`` name the same measure. Other new names are known by the value they take over.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ordered import dense_position
from quillon.session import cut

# Words of field names that mean the same in reports.
WORD_FORMS = {
    "acc": "accuracy",
    "types": "type",
    "qtype": "question_type",
    "lenient": "relaxed",
    "samples": "sample",
    "number": "num",
    "count": "num",
    "n": "num",
    "steps": "step",
}

# Words of a name that don't tell measures apart beside the others.
FILLERS = {"by", "of", "the", "in"}

# The measure of each set of words, as words in alphabetical order.
ALIASES = {
    "accuracy overall": "overall_accuracy",
    "accuracy": "overall_accuracy",
    "accuracy total": "overall_accuracy",
    "accuracy seen type": "seen_type_accuracy",
    "accuracy seen": "seen_type_accuracy",
    "accuracy type unseen": "unseen_type_accuracy",
    "accuracy unseen": "unseen_type_accuracy",
    "accuracy relaxed": "relaxed_accuracy",
    "accuracy macro question type": "macro_question_type_accuracy",
    "accuracy macro": "macro_question_type_accuracy",
    "accuracy macro type": "macro_question_type_accuracy",
    "num sample": "num_samples",
    "sample": "num_samples",
    "sample total": "num_samples",
    "global step": "global_step",
    "step train": "global_step",
    "step training": "global_step",
    "step": "global_step",
}

#: Target schema of final test reports: measure to Spark type.
REPORT_SCHEMA = {
    "overall_accuracy": "double",
    "seen_type_accuracy": "double",
    "unseen_type_accuracy": "double",
    "relaxed_accuracy": "double",
    "macro_question_type_accuracy": "double",
    "num_samples": "bigint",
    "global_step": "bigint",
}


def words_of(field: Column) -> Column:
    """The words of a field name in alphabetical order, in their plain forms."""
    snake = F.lower(F.regexp_replace(F.regexp_replace(field, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))
    words = F.split(snake, "_")
    form = F.create_map(*[F.lit(x) for kv in WORD_FORMS.items() for x in kv])
    plain = F.transform(words, lambda w: F.coalesce(F.try_element_at(form, w), w))
    flat = F.flatten(F.transform(plain, lambda w: F.split(w, "_")))
    kept = F.filter(flat, lambda w: (w != "") & ~w.isin(*sorted(FILLERS)))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def measure_of(field: Column) -> Column:
    """The measure a field name stands for: a target measure, or else its words joined by '_'."""
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    words = words_of(field)
    return F.coalesce(F.try_element_at(alias, words), F.when(words == "", F.lower(field)).otherwise(F.regexp_replace(words, " ", "_")))


def json_type(variant: Column) -> Column:
    """number, string, object, array, boolean or null of a variant."""
    kind = F.schema_of_variant(variant)
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .otherwise("number")
    )


def latest_files(files: DataFrame) -> DataFrame:
    """One row per file_id: the one received last (ties: the greater payload). Null file_ids are no files."""
    want = ["series_id", "written_at", "received_at", "payload"]
    last = F.max_by(F.struct(*want), F.struct("received_at", "payload"))
    return files.where("file_id is not null").groupBy("file_id").agg(last.alias("f")).select("file_id", "f.*")


def fields_of(files: DataFrame) -> DataFrame:
    """One row per file and top-level field: (file_id, field, measure, kind, text, inner).

    ``text`` is the value as text (JSON for objects and arrays), ``inner`` the text of an object's
    member ``value``. Payloads that are no JSON object give no rows.
    """
    parsed = files.select("file_id", F.try_parse_json("payload").alias("v"))
    parsed = parsed.where("v is not null").where(F.schema_of_variant("v").startswith("OBJECT"))
    each = files.sparkSession.tvf.variant_explode(F.col("v").outer())
    rows = parsed.lateralJoin(each).select("file_id", F.col("key").alias("field"), "value")
    return rows.select(
        "file_id",
        "field",
        measure_of(F.col("field")).alias("measure"),
        json_type(F.col("value")).alias("kind"),
        F.when(json_type(F.col("value")).isin("object", "array"), F.to_json("value")).otherwise(F.expr("try_variant_get(value, '$', 'string')")).alias("text"),
        F.when(json_type(F.col("value")) == "object", F.expr("try_variant_get(value, '$.value', 'string')")).alias("inner"),
    )


def cast_to(kind: str, text: Column, inner: Column) -> Column:
    """A reported value as ``kind``; null if it can't be cast. Percentages become shares, objects give their ``value``."""
    raw = F.trim(F.coalesce(inner, text))
    percent = raw.endswith("%")
    number = F.regexp_replace(raw, r"\s*%$", "").try_cast("double")
    if kind == "double":
        return F.when(percent, number / 100).otherwise(number)
    if kind == "bigint":
        return F.when(~percent & (number == F.floor(number)), number.cast("bigint"))
    return F.when(F.lit(kind == "string"), text)


def ingest(files: DataFrame, schema: Mapping[str, str] = REPORT_SCHEMA, *, trace: bool = False) -> DataFrame:
    """One row per file_id: file_id, series_id, written_at, the typed columns of ``schema``, ``rescued`` STRING.

    ``rescued`` is a JSON object of all unknown fields and of the uncastable ones under their own
    names, null where there are none; a payload that is no JSON object is kept whole under
    ``_payload``. If two fields of a file name one measure, the first by name fills the column and
    the others are rescued. ``trace`` adds ``fields``, an array of (measure, field, kind, text) of all
    fields that went into typed columns or ``rescued``; null if the payload is no JSON object.
    """
    last = latest_files(files)
    fields = fields_of(last)
    typed = [F.when(F.col("measure") == m, cast_to(k, F.col("text"), F.col("inner")).cast(k)).alias(f"_{m}") for m, k in schema.items()]
    rows = fields.select("*", *typed)
    fits = F.lit(False)
    for m in schema:
        fits = fits | F.col(f"_{m}").isNotNull()
    void = (F.col("kind") == "null") & F.col("measure").isin(*schema)
    rows = rows.withColumn("_fits", fits | void)
    first = {m: F.min_by(F.col(f"_{m}"), F.when(F.col(f"_{m}").isNotNull(), F.col("field"))) for m in schema}
    used = {m: F.min(F.when(F.col(f"_{m}").isNotNull(), F.col("field"))) for m in schema}
    rest = F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("_fits"), F.struct("field", "text")))))
    spare = F.collect_list(F.when(F.col("_fits") & ~void, F.struct("field", "text")))
    wide = rows.groupBy("file_id").agg(*[e.alias(m) for m, e in first.items()], *[e.alias(f"_used_{m}") for m, e in used.items()], rest.alias("_rest"), spare.alias("_spare"), F.collect_list(F.struct("measure", "field", "kind", "text")).alias("fields"))
    taken = F.array(*[F.col(f"_used_{m}") for m in schema]) if schema else F.array()
    extra = F.filter("_spare", lambda x: ~F.coalesce(F.array_contains(F.array_compact(taken), x["field"]), F.lit(False)))
    rescued = F.map_concat(F.col("_rest"), F.map_from_entries(extra))
    wide = wide.select("file_id", *schema, F.when(F.size(rescued) > 0, F.to_json(rescued, {"ignoreNullFields": "false"})).alias("rescued"), "fields")
    out = last.select("file_id", "series_id", "written_at", "payload").join(wide, "file_id", "left")
    whole = F.try_parse_json("payload").isNull() | ~F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
    keep = F.when(whole & F.col("payload").isNotNull(), F.to_json(F.create_map(F.lit("_payload"), F.col("payload")))).otherwise(F.col("rescued"))
    out = out.withColumn("rescued", keep)
    if not trace:
        return out.drop("payload", "fields")
    none = F.array().cast("array<struct<measure:string,field:string,kind:string,text:string>>")
    return out.withColumn("fields", F.when(~whole & F.col("payload").isNotNull(), F.coalesce("fields", none))).drop("payload")


def _names(measure: str):
    return lambda field: measure_of(field) == measure


def promote(table: DataFrame, approved: Mapping[str, str]) -> DataFrame:
    """``table`` of ``ingest`` with a typed column for each approved measure, filled from ``rescued``.

    Values replayed into a column leave ``rescued``; uncastable ones stay there.
    """
    out = table.withColumn("_map", F.from_json("rescued", "map<string,string>"))
    for measure, kind in approved.items():
        names = F.filter(F.map_keys("_map"), _names(measure))
        text = F.try_element_at(F.col("_map"), F.try_element_at(F.array_sort(names), F.lit(1)))
        inner = F.get_json_object(text, "$.value")
        value = cast_to(kind, text, inner).cast(kind) if kind != "string" else text
        out = out.withColumn(measure, value).withColumn("_name", F.try_element_at(F.array_sort(names), F.lit(1)))
        out = out.withColumn("_map", F.when(F.col(measure).isNotNull(), F.map_filter("_map", lambda k, v: k != F.col("_name"))).otherwise(F.col("_map")))
    kept = F.when(F.size("_map") > 0, F.to_json("_map", {"ignoreNullFields": "false"}))
    return out.withColumn("rescued", kept).drop("_map", "_name")


def telling(kind: Column, text: Column) -> Column:
    """Whether a value is one that two fields hardly share by chance: a number of five characters or more, or a text, list or object of twelve."""
    return F.coalesce(((kind == "number") & (F.length(text) >= 5)) | (kind.isin("string", "array", "object") & (F.length(text) >= 12)), F.lit(False))


def changes(files: DataFrame) -> DataFrame:
    """(file_id, field, change): what changed from the preceding file of the series by written_at, ties by file_id.

    Changes are ``added``, ``removed``, ``renamed`` and ``type_changed``; null series and files
    without a JSON object have none and are skipped as predecessors. Work is by file position, never by series, so
    a series holding a third of all files is spread like any other.
    """
    return table_changes(ingest(files, trace=True))


def table_changes(table: DataFrame) -> DataFrame:
    """``changes`` from a table of ``ingest`` with its ``fields``.

    If files hold several fields of one measure, fields of equal name go together, and what is left
    of both files is paired in the order of names. A field that is gone and a new one of another
    measure are one that was renamed if both hold the same telling value, and no others of the file do.
    """
    readable = cut(table.where("series_id is not null and fields is not null").select("file_id", "series_id", "written_at", "fields"))
    flat = readable.select("file_id", F.explode("fields").alias("f"))
    each = flat.select("file_id", "f.measure", F.struct("f.field", "f.kind").alias("state"))
    fields = cut(each.groupBy("file_id", "measure").agg(F.sort_array(F.collect_set("state")).alias("states")))
    placed = dense_position(readable, ["series_id", "written_at", "file_id"])
    at = placed.select("file_id", "series_id", "pos")
    before = at.select((F.col("pos") + 1).alias("pos"), F.col("series_id").alias("series_before"), F.col("file_id").alias("file_before"))
    linked = cut(at.join(before, "pos", "left").select("file_id", "pos", F.when(F.col("series_before") == F.col("series_id"), F.col("file_before")).alias("file_before")))
    linked = linked.where("file_before is not null").drop("pos")
    now = fields.join(linked, "file_id").withColumnRenamed("states", "now")
    old = fields.select(F.col("file_id").alias("file_before"), "measure", F.col("states").alias("old")).join(linked, "file_before")
    none = F.array().cast("array<struct<field:string,kind:string>>")
    both = now.join(old, ["file_id", "file_before", "measure"], "full").withColumn("now", F.coalesce("now", none)).withColumn("old", F.coalesce("old", none))
    both = both.withColumn("new", F.array_except("now.field", "old.field")).withColumn("gone", F.filter("old", lambda x: ~F.array_contains(F.col("now.field"), x["field"])))
    same = lambda x: F.try_element_at(F.filter("old", lambda o: o["field"] == x["field"]), F.lit(1))
    paired = lambda x: F.try_element_at("gone", F.greatest(F.array_position("new", x["field"]).cast("int"), F.lit(1)))
    before_of = lambda x: F.when(F.array_contains("new", x["field"]), paired(x)).otherwise(same(x))
    pairs = both.select("file_id", "file_before", F.explode(F.transform("now", lambda x: F.struct(x.alias("now"), before_of(x).alias("old")))).alias("p"))
    here = cut(pairs.select("file_id", "file_before", "p.now.field", "p.now.kind", F.col("p.old.field").alias("field_before"), F.col("p.old.kind").alias("kind_before")))
    added = here.where("field_before is null").select("file_id", "field", F.lit("added").alias("change"))
    renamed = here.where("field_before <> field").select("file_id", "field", F.lit("renamed").alias("change"))
    gone = both.select("file_id", "file_before", F.explode(F.slice("gone", F.size("new") + 1, F.size("gone") + 1)).alias("x")).select("file_id", "file_before", F.col("x.field").alias("was"))
    told = cut(flat.where(telling(F.col("f.kind"), F.col("f.text"))).select("file_id", "f.field", "f.kind", "f.text"))
    fresh = here.where("field_before is null").select("file_id", "field").join(told, ["file_id", "field"])
    lost = gone.join(told.select(F.col("file_id").alias("file_before"), F.col("field").alias("was"), "kind", "text"), ["file_before", "was"]).select("file_id", "was", "kind", "text")
    by_value = fresh.join(lost, ["file_id", "kind", "text"]).groupBy("file_id", "kind", "text").agg(F.min("field").alias("field"), F.min("was").alias("was"), F.count(F.lit(1)).alias("n")).where("n = 1")
    by_value = cut(by_value.select("file_id", "field", "was"))
    added = added.join(by_value.select("file_id", "field"), ["file_id", "field"], "left_anti")
    renamed = renamed.unionByName(by_value.select("file_id", "field", F.lit("renamed").alias("change")))
    removed = both.select("file_id", F.explode(F.slice("gone", F.size("new") + 1, F.size("gone") + 1)).alias("x")).select("file_id", "x.field", F.lit("removed").alias("change"))
    removed = removed.join(by_value.select("file_id", F.col("was").alias("field")), ["file_id", "field"], "left_anti")
    # The type before: of the preceding file, or while that is null, of the file before it, and so on.
    known = here.where("kind <> 'null' and kind_before <> 'null'").select("file_id", "field", "kind", F.col("kind_before").alias("past"))
    open_rows = here.where("kind <> 'null' and kind_before = 'null'").select("file_id", "field", "kind", F.col("file_before").alias("at"), F.col("field_before").alias("name"))
    step = here.where("kind_before is not null").select(F.col("file_id").alias("at"), F.col("field").alias("name"), F.col("file_before").alias("next"), F.col("field_before").alias("name_next"), F.col("kind_before").alias("kind_next"))
    open_rows = cut(open_rows)
    while not open_rows.isEmpty():
        moved = cut(open_rows.join(step, ["at", "name"]).select("file_id", "field", "kind", F.col("next").alias("at"), F.col("name_next").alias("name"), "kind_next"))
        known = known.unionByName(moved.where("kind_next <> 'null'").select("file_id", "field", "kind", F.col("kind_next").alias("past")))
        open_rows = moved.where("kind_next = 'null'").drop("kind_next")
        further = step.select(F.col("at").alias("next"), F.col("name").alias("name_next"), F.col("next").alias("next2"), F.col("name_next").alias("name2"), F.col("kind_next").alias("kind2"))
        leap = step.where("kind_next = 'null'").join(further, ["next", "name_next"]).select("at", "name", F.col("next2").alias("next"), F.col("name2").alias("name_next"), F.col("kind2").alias("kind_next"))
        step = cut(step.where("kind_next <> 'null'").unionByName(leap))
    typed = known.where("kind <> past").select("file_id", "field", F.lit("type_changed").alias("change"))
    return added.unionByName(removed).unionByName(renamed).unionByName(typed).distinct()
