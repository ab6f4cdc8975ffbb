"""Model and prompt registries as replays of action logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stages, and the steps allowed between them.
STAGES = ("None", "Staging", "Production", "Archived")
ALLOWED = (("None", "Staging"), ("Staging", "Production"), ("Staging", "Archived"), ("Production", "Staging"), ("Production", "Archived"))


def replay(actions: DataFrame) -> DataFrame:
    """Each action(seq, action, model, version, to_stage, actor, and rollback, if it is there) with status, from_stage and stage, in order of seq.

    Actions: create_model (again: ok, nothing changes), create_version (again: conflict), transition (unknown
    version: not_found; a step that isn't allowed: illegal; to Production: the version there before goes
    to Archived).  Whether a step is allowed depends on the outcome of those before, so a model's actions are
    replayed one after another; models are independent.  Rows are sorted by model and pass through in batches,
    with the open model's stages carried along, so a model's log never stands in memory whole.
    """

    names = {s.lower(): s for s in STAGES}

    def step(r, known: bool, stage: dict[str, str]) -> tuple[str, str | None, str | None]:
        """Status, stage before and stage after of one action; ``stage`` is changed."""
        before = stage.get(r.version)
        if r.action == "create_model":
            return "ok", before, None
        if r.action == "create_version":
            if not known:
                return "not_found", before, None
            if r.version in stage:
                return "conflict", before, before
            stage[r.version] = "None"
            return "ok", before, "None"
        if r.action != "transition":
            return "unknown_action", before, None
        to = names.get(str(r.to_stage).lower())
        if before is None:
            return "not_found", before, None
        if to is None or (before, to) not in ALLOWED:
            return "illegal", before, before
        if to == "Production":
            for v, s in stage.items():
                if s == "Production" and v != r.version:
                    stage[v] = "Archived"
        stage[r.version] = to
        return "ok", before, to

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known, stage = None, False, {}
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if r.model != model:
                    model, known, stage = r.model, False, {}
                out.append(step(r, known, stage))
                known = known or r.action == "create_model"
            yield rows.assign(status=[o[0] for o in out], from_stage=[o[1] for o in out], stage=[o[2] for o in out])

    schema = "seq long, action string, model string, version string, to_stage string, actor string, rollback boolean, status string, from_stage string, stage string"
    rollback = F.coalesce("rollback", F.lit(False)) if "rollback" in actions.columns else F.lit(False)
    rows = actions.select("seq", "action", "model", "version", "to_stage", "actor", rollback.alias("rollback"))
    return rows.repartition("model").sortWithinPartitions("model", "seq").mapInPandas(work, schema)


def models_with_versions(models: DataFrame, versions: DataFrame) -> DataFrame:
    """Every version beside its model, by the model's id: models(id, name, owner), versions(model_id, version, stage)."""
    return versions.join(models.select(F.col("id").alias("model_id"), "name", "owner"), "model_id").select("name", "owner", "version", "stage")


def at_stage(versions: DataFrame, stage: str, role: str | None = None) -> DataFrame:
    """Versions at a stage, of one role where it is asked for."""
    found = versions.where(F.col("stage") == stage)
    return found if role is None else found.where(F.col("role") == role)


def production(replayed: DataFrame) -> DataFrame:
    """(model, version): the version that the last promotion left in Production, if nothing has moved it since."""
    moved = replayed.where("status = 'ok' and stage is not null")
    w = Window.partitionBy("model", "version").orderBy(F.desc("seq"))
    last = moved.withColumn("_r", F.row_number().over(w)).where("_r = 1 and stage = 'Production'")
    newest = Window.partitionBy("model").orderBy(F.desc("seq"))
    return last.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("model", "version")


def audit(replayed: DataFrame) -> DataFrame:
    """(seq, model, version, action, actor, from_stage, to_stage, detail) of what changed; the demotion of another version isn't listed.

    detail: whether a transition was a rollback, as JSON.
    """
    detail = F.when(F.col("action") == "transition", F.to_json(F.struct(F.col("rollback").alias("rollback_to"))))
    return replayed.where("status = 'ok' and action in ('create_version', 'transition')").select("seq", "model", "version", "action", "actor",
        "from_stage", F.col("stage").alias("to_stage"), detail.alias("detail"))


def resolve_prompts(requests: DataFrame, prompts: DataFrame, default: str = "v2") -> DataFrame:
    """requests(name, header_version, body_version) with version, prompt_id and template; an unknown prompt stops the job."""
    version = F.coalesce("header_version", "body_version", F.lit(default))
    found = requests.withColumn("version", version).join(prompts.select("name", "version", "template"), ["name", "version"], "left")
    missing = F.raise_error(F.concat(F.lit("no prompt "), F.col("name"), F.lit(":"), F.col("version")))
    return found.withColumn("template", F.when(F.col("template").isNull(), missing).otherwise(F.col("template"))).withColumn("prompt_id", F.concat_ws(":", "name", "version"))


def prompt_versions(prompts: DataFrame) -> DataFrame:
    """One row: the versions as sorted text (v10 before v2)."""
    return prompts.agg(F.array_sort(F.collect_set("version")).alias("versions"))


def kb_version(docs: DataFrame, previous: int, dim: int, model: str, stamp: int | None = None) -> DataFrame:
    """One row, a knowledge base's manifest after an update: kb_version, version ("4-kb", or "4-kb+stamp"), doc_count, dim, model."""
    now = previous + 1
    name = f"{now}-kb" + (f"+{stamp}" if stamp is not None else "")
    return docs.agg(F.count("*").alias("doc_count")).select(F.lit(now).alias("kb_version"), F.lit(name).alias("version"), "doc_count",
        F.lit(dim).alias("dim"), F.lit(model).alias("model"))
