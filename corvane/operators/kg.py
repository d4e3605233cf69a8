"""Entities and relations: clean-up of extraction records, merging, links, incremental reuse."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from . import graph
from .chunking import numbered

# Fixed values -----------------------------------------------------------------------------------------------------
ENTITY_TYPES = ["Paper", "Contribution", "Method", "Model", "Module", "Dataset", "Metric", "Task", "Problem", "Scenario", "Concept", "Experiment", "Finding", "Result", "Limitation", "FutureWork", "Application", "Author", "Organization", "Other"]
RELATION_TYPES = ["proposes", "uses", "has_component", "evaluated_on", "evaluated_by", "reports_result", "has_finding", "solves", "addresses_scenario", "improves_on", "compares_with", "has_limitation", "has_future_work", "similar_to", "defines", "has_property", "formulates_as", "outputs", "supports", "authored_by", "affiliated_with", "extends", "mentions", "other"]
ENTITY_ALIASES = {"claim": "Contribution", "conclusion": "Finding", "experimental_conclusion": "Finding", "experimental_finding": "Finding", "future_direction": "FutureWork", "future_work": "FutureWork", "issue": "Problem", "module_component": "Module", "problem_setting": "Scenario", "research_question": "Problem"}
RELATION_ALIASES = {
    "address": "solves",
    "addresses": "solves",
    "addresses_problem": "solves",
    "compared_to": "compares_with",
    "contains": "has_component",
    "employs": "uses",
    "evaluated_by_metric": "evaluated_by",
    "has_metric": "evaluated_by",
    "has_result": "reports_result",
    "introduces": "proposes",
    "is_evaluated_by": "evaluated_by",
    "is_evaluated_on": "evaluated_on",
    "related_to": "similar_to",
    "reports_metric": "evaluated_by",
    "solves_problem": "solves",
    "uses_component": "has_component",
    "improves": "improves_on",
}
TYPE_PRIORITY = ["Paper", "Contribution", "Method", "Model", "Module", "Dataset", "Metric", "Task", "Problem", "Scenario", "Finding", "Result", "Limitation", "FutureWork", "Application", "Concept", "Experiment", "Author", "Organization", "Other"]
MAX_ENTITIES, MAX_RELATIONS, NAME_CHARS, TEXT_CHARS, EVIDENCE_CHARS, ATTRIBUTE_CHARS, MAX_ALIASES = 14, 20, 160, 600, 300, 80, 8
# -------------------------------------------------------------------------------------------------------------------


def clean_type(raw: Column, types: list[str], aliases: dict[str, str]) -> Column:
    """By alias, else by name without regard to case and separators, else the last type."""
    s = T.slug(raw)
    lookup = {re.sub(r"[^a-z0-9]+", "_", t.lower()).strip("_"): t for t in types} | aliases
    table = F.create_map(*[F.lit(x) for kv in lookup.items() for x in kv])
    return F.coalesce(F.try_element_at(table, s), F.lit(types[-1]))


def entity_id(name: Column) -> Column:
    return F.substring(F.sha1(T.canonical_name(name)), 1, 16)


def last_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """Of records that share a key the last one counts."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _field(rows: DataFrame, struct: str, name: str, kind: str) -> Column:
    """A field of the struct column, null where records lack it."""
    has = name in rows.schema[struct].dataType.fieldNames()
    return F.col(f"{struct}.{name}") if has else F.lit(None).cast(kind)


def entities_of(records: DataFrame) -> DataFrame:
    """chunk_key, pos, name, type, aliases, description, attributes of each usable entity; a record's first MAX_ENTITIES count."""
    e = records.filter("status = 'ok'").select("chunk_key", F.posexplode(F.slice("entities", 1, MAX_ENTITIES)).alias("pos", "e"))
    name = F.substring(T.collapse(F.col("e.name")), 1, NAME_CHARS)
    aliases = F.filter(F.transform(F.coalesce(_field(e, "e", "aliases", "array<string>"), F.array().cast("array<string>")), lambda x: F.substring(T.collapse(x), 1, NAME_CHARS)), lambda x: x != "")
    attributes = F.coalesce(_field(e, "e", "attributes", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return e.select(
        "chunk_key",
        "pos",
        name.alias("name"),
        clean_type(F.coalesce(F.col("e.type"), F.lit("")), ENTITY_TYPES, ENTITY_ALIASES).alias("type"),
        F.slice(F.array_distinct(aliases), 1, MAX_ALIASES).alias("aliases"),
        F.substring(F.btrim(F.coalesce(F.col("e.description"), F.lit(""))), 1, TEXT_CHARS).alias("description"),
        F.transform_values(attributes, lambda k, v: F.substring(v, 1, EVIDENCE_CHARS)).alias("attributes"),
    ).filter("name <> ''")


def relations_of(records: DataFrame) -> DataFrame:
    """chunk_key, pos, subject, predicate, object, description, evidence; a record's first MAX_RELATIONS count."""
    r = records.filter("status = 'ok'").select("chunk_key", F.posexplode(F.slice("relations", 1, MAX_RELATIONS)).alias("pos", "r"))
    return r.select(
        "chunk_key",
        "pos",
        T.canonical_name(F.col("r.subject")).alias("subject"),
        clean_type(F.coalesce(F.col("r.predicate"), F.lit("")), RELATION_TYPES, RELATION_ALIASES).alias("predicate"),
        T.canonical_name(F.col("r.object")).alias("object"),
        F.substring(F.btrim(F.coalesce(F.col("r.description"), F.lit(""))), 1, TEXT_CHARS).alias("description"),
        F.substring(F.btrim(F.coalesce(_field(r, "r", "evidence", "string"), F.lit(""))), 1, TEXT_CHARS).alias("evidence"),
    )


def _longest(text: str) -> Column:
    """The longest of a group's texts, of equally long ones the first by chunk and place."""
    return F.min_by(text, F.struct((-F.length(text)).alias("n"), F.col("chunk_key").alias("c"), F.col("pos").alias("p")))


def named(entities: DataFrame) -> DataFrame:
    """entities with canonical_name, to be written where several steps read them: names are cleaned once then."""
    return _keyed(entities, None)


def _keyed(entities: DataFrame, keys: DataFrame | None) -> DataFrame:
    """entities with canonical_name: of the entity that a row belongs to."""
    if keys is None and "canonical_name" in entities.columns:
        return entities
    if keys is None:
        return entities.withColumn("canonical_name", T.canonical_name(F.col("name"))).filter("canonical_name <> ''")
    return entities.join(keys, ["chunk_key", "pos"]).withColumnRenamed("key", "canonical_name")


def merged_entities(entities: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """By canonical name, or with keys (entity_keys) by the entity that names and aliases resolve to, whose other names are aliases then: id, name (the first spelling by chunk and place), type (the most important seen), types, aliases, attributes (the last
    value of each), longest description, number of chunks; the chunks themselves are links().

    All sums are partial before the shuffle; the sets are of names and types, not of rows."""
    rank = F.array_position(F.array(*map(F.lit, TYPE_PRIORITY)), F.col("type"))
    c = _keyed(entities, keys)
    if keys is not None:
        c = c.withColumn("aliases", F.when(T.canonical_name(F.col("name")) == F.col("canonical_name"), F.col("aliases")).otherwise(F.concat("aliases", F.array("name"))))
    at = F.struct("chunk_key", "pos")
    out = c.groupBy("canonical_name").agg(
        F.min_by("name", at).alias("name"),
        F.min_by("type", rank).alias("type"),
        F.array_sort(F.collect_set("type")).alias("observed_types"),
        _longest("description").alias("description"),
        F.countDistinct("chunk_key").alias("n_chunks"),
    )
    names = c.select("canonical_name", F.explode("aliases").alias("alias")).groupBy("canonical_name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    values = c.select("canonical_name", at.alias("at"), F.explode("attributes").alias("k", "v")).groupBy("canonical_name", "k").agg(F.max_by("v", "at").alias("v"))
    values = values.groupBy("canonical_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    out = out.join(names, "canonical_name", "left").join(values, "canonical_name", "left")
    return out.select(
        F.substring(F.sha1("canonical_name"), 1, 16).alias("entity_id"),
        "canonical_name",
        "name",
        "type",
        "observed_types",
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        "description",
        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
        "n_chunks",
    )


def local_names(entities: DataFrame, keys: DataFrame) -> DataFrame:
    """chunk_key, name, entity_id: what the names of a record's entities, and their aliases, mean within it; the last row of a record counts."""
    rows = _keyed(entities, keys).select("chunk_key", "pos", F.explode(_names()).alias("name"), F.substring(F.sha1("canonical_name"), 1, 16).alias("entity_id"))
    return rows.groupBy("chunk_key", "name").agg(F.max_by("entity_id", "pos").alias("entity_id"))


def resolved_relations(relations: DataFrame, entities: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """relations with subject_id, object_id and relation_id; ends that are no entity, and relations to oneself, go. local (local_names): what names mean within a
    record; a name that means nothing there means the entity that has it as its name or as an alias, the first by canonical name of several."""
    if local is not None:
        own = F.array_distinct(F.concat(F.array("canonical_name"), F.transform("aliases", T.canonical_name)))
        anywhere = entities.select(F.explode(own).alias("end"), F.struct("canonical_name", "entity_id").alias("e")).groupBy("end").agg(F.min("e").alias("e")).select("end", F.col("e.entity_id").alias("any_id"))
        r = relations
        for end in ("subject", "object"):
            here = local.select("chunk_key", F.col("name").alias(end), F.col("entity_id").alias("here_id"))
            r = r.join(here, ["chunk_key", end], "left").join(anywhere.withColumnRenamed("end", end), end, "left").withColumn(f"{end}_id", F.coalesce("here_id", "any_id")).drop("here_id", "any_id")
        r = r.filter("subject_id <> object_id")
        return r.withColumn("relation_id", F.substring(F.sha1(F.concat_ws("|", "subject_id", "predicate", "object_id")), 1, 16))
    known = entities.select("canonical_name", "entity_id")
    s = known.select(F.col("canonical_name").alias("subject"), F.col("entity_id").alias("subject_id"))
    o = known.select(F.col("canonical_name").alias("object"), F.col("entity_id").alias("object_id"))
    r = relations.join(s, "subject").join(o, "object").filter("subject_id <> object_id")
    return r.withColumn("relation_id", F.substring(F.sha1(F.concat_ws("|", "subject_id", "predicate", "object_id")), 1, 16))


def merged_relations(relations: DataFrame, entities: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """By subject, predicate and object: longest description, evidence (a set), number of chunks and of mentions; the chunks are relation_links()."""
    return merged_resolved(resolved_relations(relations, entities, local))


def merged_resolved(r: DataFrame) -> DataFrame:
    """merged_relations of relations that are resolved (resolved_relations)."""
    return r.groupBy("relation_id", "subject_id", "predicate", "object_id").agg(
        _longest("description").alias("description"),
        F.array_sort(F.collect_set(F.nullif(F.col("evidence"), F.lit("")))).alias("evidence"),
        F.countDistinct("chunk_key").alias("n_chunks"),
        F.count(F.lit(1)).alias("n"),
    )


def links(entities: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return _keyed(entities, keys).select(F.substring(F.sha1("canonical_name"), 1, 16).alias("entity_id"), "chunk_key").distinct()


def relation_links(relations: DataFrame, entities: DataFrame, local: DataFrame | None = None) -> DataFrame:
    return resolved_relations(relations, entities, local).select("relation_id", "chunk_key").distinct()


def relations_by_entity(relations: DataFrame) -> DataFrame:
    """entity_id, relation_id: each relation at both of its ends, once for a relation to oneself."""
    return relations.select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id"), "relation_id")


def entity_text(rows: DataFrame) -> Column:
    """The lines that an entity is embedded by."""
    return T.labelled({"Name": F.col("name"), "Type": F.col("type"), "Aliases": F.array_join(F.slice("aliases", 1, 8), ", "), "Description": F.col("description"), "Attributes": T.sorted_json(F.col("attributes"))})


def entity_search_text(rows: DataFrame) -> Column:
    return F.lower(T.collapse(F.concat_ws(" ", "name", "canonical_name", "type", "description", F.array_join("aliases", " "), F.array_join("observed_types", " "))))


def relation_search_text(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations with subject and object (names) and searchable; an end without an entity adds nothing."""
    s = entities.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("subject"))
    o = entities.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object"))
    r = relations.join(s, "subject_id", "left").join(o, "object_id", "left")
    return r.withColumn("searchable", F.lower(T.collapse(F.concat_ws(" ", "predicate", "description", "subject", "object", F.array_join("evidence", " ")))))


def output_order(entities: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """The table with row numbers in the order that it is written in: entities by type and name, relations by predicate and ends."""
    if entities is not None:
        return numbered(entities.withColumn("_low", F.lower("name")), ["type", "_low", "entity_id"], name="place").drop("_low")
    return numbered(relations, ["predicate", "subject_id", "object_id"], name="place")


def migrated(cache: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Cached records with their provenance columns as the chunks have them now; records of chunks that are gone stay as they are."""
    now = chunks.select("chunk_key", *[F.col(c).alias(f"_{c}") for c in columns])
    j = cache.join(now, "chunk_key", "left")
    return j.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in cache.columns])


def to_extract(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks that the cache doesn't hold with the same text and without an error."""
    return chunks.join(cache.filter("status = 'ok'").select("chunk_key", "text_hash"), ["chunk_key", "text_hash"], "left_anti")


def _names() -> Column:
    """Canonical names of a row: its own and its aliases', each once, none empty."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), F.col("aliases")), T.canonical_name), lambda x: x != ""))


def entity_keys(entities: DataFrame) -> DataFrame:
    """chunk_key, pos, key for each row with a canonical name: the entity that it belongs to, named by the canonical name that founded it.

    In the order of chunk and place, a row belongs to the entity that the first known one of its names points to, or founds one; from then on all of its names point
    there, whatever they pointed to. Names of different components of the graph of names and aliases never meet, so each component is gone through by itself,
    in order, a row at a time: what is held is where the component's names point. Rows of a name that no alias joins to another need none of this."""
    rows = entities.select("chunk_key", "pos", _names().alias("names"), T.canonical_name(F.col("name")).alias("own")).filter("own <> ''")
    joined = rows.select("own", F.explode("names").alias("other")).filter("own <> other").select(F.col("own").alias("src"), F.col("other").alias("dst")).distinct()
    of = graph.components(joined)
    told = rows.join(of, F.col("own") == F.col("node"), "left")
    alone = told.filter("component IS NULL").select("chunk_key", "pos", F.col("own").alias("key"))
    kind = entities.schema["chunk_key"].dataType.simpleString(), entities.schema["pos"].dataType.simpleString()

    def work(batches):
        at, points = None, {}
        for batch in batches:
            keys = []
            for component, names in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if component != at:
                    at, points = component, {}
                key = next((points[x] for x in names if x in points), names[0])
                points.update(dict.fromkeys(names, key))
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string())], names=["chunk_key", "pos", "key"])

    ordered = told.filter("component IS NOT NULL").select("chunk_key", "pos", "component", "names").repartition("component").sortWithinPartitions("component", "chunk_key", "pos")
    return alone.unionByName(ordered.mapInArrow(work, f"chunk_key {kind[0]}, pos {kind[1]}, key string"))


class PatternExtractor:
    """Offline stand-in for a model that extracts entities: capitalised words of six ASCII letters or more are entities, in order of first
    appearance, and each is related to the next one. Records are one for each chunk."""

    def records(self, chunks: DataFrame, key: str, text: str) -> DataFrame:
        names = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"([A-Z][a-z]{5,})"), F.lit(1)))
        d = chunks.select(F.col(key).cast("string").alias("chunk_key"), F.substring(F.sha1(T.collapse(F.col(text))), 1, 16).alias("text_hash"), names.alias("n"))
        ent = F.transform(
            "n",
            lambda x: F.struct(
                x.alias("name"),
                F.when(F.length(x) % 2 == 0, "issue").when(F.length(x) % 7 == 0, "Method").otherwise("Concept").alias("type"),
                F.array(F.upper(x)).alias("aliases"),
                F.concat(x, F.lit(" seen")).alias("description"),
                F.create_map(F.lit("letters"), F.length(x).cast("string")).alias("attributes"),
            ),
        )
        rel = F.expr("transform(slice(n, 2, greatest(size(n) - 1, 0)), (x, i) -> named_struct('subject', n[i], 'predicate', if(length(x) % 3 = 0, 'introduces', 'mentions'), 'object', x, 'description', concat(n[i], ' before ', x), 'evidence', concat(n[i], ' ', x)))")
        return d.select("chunk_key", "text_hash", F.lit("ok").alias("status"), ent.alias("entities"), rel.alias("relations"))
