"""Readers and writers of the file formats that triples, texts, labels and evaluation sets come in."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text


def detect_encoding(spark: SparkSession, path: str, probe: int = 100) -> str:
    """utf-8, gb18030 or gbk: the first that decodes the first lines of a file; utf-8 if none does."""
    lines = [bytes(r[0]) for r in spark.read.text(path).limit(probe).select(F.col("value").cast("binary")).collect()]
    for name in ("utf-8", "gb18030", "gbk"):
        try:
            for line in lines:
                line.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return "utf-8"


def _csv_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of a CSV file; ones beyond Unicode and Latin need a setting of the session, which is made here."""
    name = detect_encoding(spark, path)
    if name != "utf-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return name


def read_triples(spark: SparkSession, path: str, strict: bool = True, line_breaks: bool = True) -> DataFrame:
    """Raw triples from .jsonl, .json (array or one object) or .csv (header), with defaults for missing fields and `seq`, the order of input.

    With `strict`, malformed lines and unknown suffixes are errors; without, an unknown suffix gives no rows. A CSV file is read by one task, as its values
    may have line breaks; without `line_breaks`, where none has, it is split.
    """
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    reader = spark.read.schema(schemas.RAW_TRIPLE)
    if suffix == "jsonl":
        rows = reader.option("mode", "FAILFAST").json(path)
    elif suffix == "json":
        rows = reader.option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    elif suffix == "csv":
        names = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)
        rows = names.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in names.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.RAW_TRIPLE))
    elif strict:
        raise ValueError(f"unknown format: {path}")
    else:
        rows = spark.createDataFrame([], schemas.RAW_TRIPLE)
    return with_defaults(rows.withColumn("seq", F.monotonically_increasing_id()))


def read_fused(spark: SparkSession, path: str) -> DataFrame:
    """Fused triples from JSON lines, with `seq`: the best score first, of equal ones by names. Malformed lines are an error."""
    rows = spark.read.schema(schemas.FUSED_TRIPLE).option("mode", "FAILFAST").json(path)
    return rows.withColumn("seq", F.struct((-F.col("edge_score")).alias("rank"), "relation", "tail"))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Empty head and tail, RELATED_TO, unknown source and confidence 1.0 where they are missing."""
    return rows.withColumns({
        "head": F.coalesce("head", F.lit("")), "tail": F.coalesce("tail", F.lit("")), "relation": F.coalesce("relation", F.lit("RELATED_TO")),
        "source": F.coalesce("source", F.lit("unknown")), "confidence": text.confidence(F.col("confidence")),
    })


def read_eav(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """A headerless file of entity, predicate, value; shorter rows are skipped. `seq` is the order of input. For `line_breaks` see read_triples."""
    rows = spark.read.schema("entity string, predicate string, value string").option("encoding", _csv_encoding(spark, path)).option("multiLine", line_breaks).option("escape", '"').csv(path)
    first = F.regexp_replace("entity", "^﻿", "")
    return rows.withColumns({"entity": first, "seq": F.monotonically_increasing_id()}).filter("value is not null")


def read_wide(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """A file with a header, one entity a row; all columns are strings. `seq` is the order of input. For `line_breaks` see read_triples."""
    rows = spark.read.option("header", True).option("encoding", _csv_encoding(spark, path)).option("multiLine", line_breaks).option("escape", '"').csv(path)
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns)).withColumn("seq", F.monotonically_increasing_id())


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): whole files, the source being the file's name without its suffix."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("source"), F.col("value").alias("text"))


def read_label_sequences(spark: SparkSession, path: str, skip_bad: bool = True) -> DataFrame:
    """(text, labels) from JSON lines; labels may be an array or a string with blanks. Bad lines go, or are an error."""
    from ..operators.labels import normalize_labels

    lines = spark.read.text(path).filter(text.strip(F.col("value")) != "")
    row = F.from_json("value", "text string, labels string", {"mode": "PERMISSIVE"})
    rows = lines.select(row.alias("r")).select("r.text", F.col("r.labels").alias("raw"))
    labels = F.coalesce(F.from_json("raw", "array<string>"), F.filter(F.split("raw", r"(?U)\s+"), lambda x: x != ""))
    rows = rows.select("text", normalize_labels(labels).alias("labels"))
    good = F.coalesce((F.col("text") != "") & (F.size("labels") == F.length("text")), F.lit(False))
    if not skip_bad:
        return rows.filter(F.when(good, True).otherwise(F.raise_error(F.lit("empty text, or labels and text differ in length")).cast("boolean")))
    return rows.filter(good)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples from JSON lines; malformed ones and those without question, gold_answers or intent are skipped."""
    lines = spark.read.text(path).filter(text.strip(F.col("value")) != "")
    named = [F.get_json_object("value", f"$.{k}").isNotNull() for k in ("question", "gold_answers", "intent")]
    rows = lines.filter(named[0] & named[1] & named[2]).select(F.from_json("value", schemas.EVAL_SET).alias("r")).select("r.*")
    return rows.filter("question is not null and intent is not null and gold_answers is not null")


def read_ontology(path: str) -> tuple[dict[str, str], dict[str, str]]:
    """(label names, relation names) of an ontology file: each alias, of a label in upper case too, to its id. A missing or broken file gives none.

    Both go to `extract.map_label` and `extract.map_relation`. The file is small and read by the driver.
    """
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}, {}
    labels = {form: kind["id"] for kind in found.get("entity_types", []) for alias in kind.get("aliases", []) for form in (alias, alias.upper())}
    return labels, {alias: kind["id"] for kind in found.get("relation_types", []) for alias in kind.get("aliases", [])}


@dataclass(frozen=True)
class Settings:
    """What a settings file says, by section, under the names that the functions take: `build` for build.build and fusion, `rules` for
    rules.run_rules (with `enabled` apart), `spans` and `relations` for the extractors, `samples` for evaluate.gold_set, `answers` for qa."""

    build: dict
    rules: dict
    spans: dict
    relations: dict
    samples: dict
    answers: dict
    ontology: str | None = None
    reports: str | None = None
    rules_enabled: bool = True


def read_configuration(path: str) -> Settings:
    """All sections of a settings file, JSON or (by its suffix, .yaml or .yml) YAML. Missing keys are left out, so that defaults hold.

    Keys: fusion (see `read_settings`), reasoning.enabled and max_inferences, nlp.ner.min_score, nlp.relation.min_score, eval.samples_per_type,
    random_seed and output_dir, api.default_top_k, schema.path."""
    found = _settings(path)
    section = lambda *names: _inside(found, names)
    given = lambda **kept: {k: v for k, v in kept.items() if v is not None}
    reasoning, sampling = section("reasoning"), section("eval")
    return Settings(
        build=_build_settings(found), rules=given(max_inferences=reasoning.get("max_inferences")), spans=given(least=section("nlp", "ner").get("min_score")), relations=given(least=section("nlp", "relation").get("min_score")),
        samples=given(samples=sampling.get("samples_per_type"), seed=sampling.get("random_seed")), answers=given(top_k=section("api").get("default_top_k")),
        ontology=section("schema").get("path"), reports=sampling.get("output_dir"), rules_enabled=bool(reasoning.get("enabled", True)),
    )


def _inside(found: dict, names: tuple[str, ...]) -> dict:
    for n in names:
        found = (found or {}).get(n) or {}
    return found


def _settings(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.lower().endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{path}: YAML needs the package yaml; JSON does not") from e
            return yaml.safe_load(f) or {}
        return json.load(f)


def read_settings(path: str) -> dict:
    """The settings of a build from a JSON or YAML file: `fuzzy`, `allow_multi`, `weights` and the three weights of a score, as `build.build` takes them.

    Keys: fusion.enable_fuzzy, fuzzy_threshold, allow_multi_relations, source_weights, and scoring.frequency_weight, source_weight, confidence_weight.
    """
    return _build_settings(_settings(path))


def _build_settings(found: dict) -> dict:
    fusion = found.get("fusion") or {}
    scoring = fusion.get("scoring") or {}
    given = {
        "fuzzy": float(fusion.get("fuzzy_threshold", 90)) if fusion.get("enable_fuzzy") else None, "allow_multi": fusion.get("allow_multi_relations"), "weights": fusion.get("source_weights"),
        "frequency_weight": scoring.get("frequency_weight"), "source_weight_": scoring.get("source_weight"), "confidence_weight": scoring.get("confidence_weight"),
    }
    return {k: v for k, v in given.items() if v is not None}


def write_fused(fused: DataFrame, path: str, created_at: str | None = None, compression: str = "none") -> None:
    """Fused triples as JSON lines, the best score first, without types. `compression` (gzip, zstd) makes the files, which repeat names of fields and sources, a fraction; read_fused
    knows it by their names."""
    columns = [f.name for f in schemas.FUSED_TRIPLE]
    stamp = F.coalesce(F.lit(created_at), F.current_timestamp().cast("string")).alias("created_at")
    fused.orderBy("seq").select(*columns, stamp).write.mode("overwrite").option("compression", compression).json(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """Raw triples as JSON lines, properties last; what `read_triples` reads."""
    columns = [F.col(f.name) for f in schemas.RAW_TRIPLE if f.name in triples.columns]
    triples.select(*columns).write.mode("overwrite").json(path)


def write_conflicts(conflicts: DataFrame, path: str) -> None:
    """The conflict report as JSON lines."""
    conflicts.select("head", "relation", "tails", "sources").write.mode("overwrite").json(path)


def write_eval_set(samples: DataFrame, path: str) -> None:
    """Evaluation samples as JSON lines; the entity of a sample is its mention."""
    rows = samples if "entity_mentions" in samples.columns else samples.withColumn("entity_mentions", F.array("entity"))
    rows.select(*(f.name for f in schemas.EVAL_SET)).write.mode("overwrite").json(path)


def write_alias_map(canonical: DataFrame, path: str) -> None:
    """The canonical map (name, canonical) and, beside it, the aliases of each canonical name."""
    canonical.write.mode("overwrite").json(f"{path}/canonical_map")
    canonical.groupBy("canonical").agg(F.sort_array(F.collect_set("name")).alias("aliases")).write.mode("overwrite").json(f"{path}/alias_map")


def write_report(spark: SparkSession, report: str, path: str, stamp: str) -> None:
    """A report as text, as the latest one and under its time stamp."""
    for name in ("latest_report", f"report_{stamp}"):
        spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A new version of the graph; edges are laid out by relation type, so that hops read one directory."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
