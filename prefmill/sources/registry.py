"""Named dataset descriptions and how their columns and tags are resolved."""

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, functions as F

# Column and tag names used when a description does not override them.
COLUMN_DEFAULTS = {
    "prompt": "instruction", "query": "input", "response": "output", "history": None, "messages": "conversations",
    "system": None, "tools": None, "images": None, "videos": None, "audios": None,
    "chosen": None, "rejected": None, "kto_tag": None,
}
TAG_DEFAULTS = {
    "role_tag": "from", "content_tag": "value", "user_tag": "human", "assistant_tag": "gpt",
    "observation_tag": "observation", "function_tag": "function_call", "system_tag": "system",
}
# Where the data comes from, strongest first.
SOURCE_KEYS = [("hf_hub_url", "hub"), ("ms_hub_url", "hub"), ("om_hub_url", "hub"), ("script_url", "script"),
               ("cloud_file_name", "cloud_file"), ("file_name", "file")]
PAIR_STAGES = ("rm", "dpo")


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    load_from: str = "file"
    location: str = ""
    formatting: str = "alpaca"
    ranking: bool = False
    subset: str | None = None
    split: str = "train"
    folder: str | None = None
    num_samples: int | None = None
    prompt: str | None = "instruction"
    query: str | None = "input"
    response: str | None = "output"
    history: str | None = None
    messages: str | None = "conversations"
    system: str | None = None
    tools: str | None = None
    images: str | None = None
    videos: str | None = None
    audios: str | None = None
    chosen: str | None = None
    rejected: str | None = None
    kto_tag: str | None = None
    role_tag: str | None = "from"
    content_tag: str | None = "value"
    user_tag: str | None = "human"
    assistant_tag: str | None = "gpt"
    observation_tag: str | None = "observation"
    function_tag: str | None = "function_call"
    system_tag: str | None = "system"

    def tagged(self, **changes) -> "DatasetSpec":
        return replace(self, **changes)


def resolve(names: list[str], registry: dict[str, dict]) -> list[DatasetSpec]:
    """Specs for the named datasets. A given ``columns`` (or ``tags``) block replaces the whole default block: keys it
    leaves out become None."""
    out = []
    known = {f.name for f in fields(DatasetSpec)}
    for name in names:
        if name not in registry:
            raise ValueError(f"undefined dataset {name}")
        entry = registry[name]
        source = next(((kind, entry[key]) for key, kind in SOURCE_KEYS if key in entry), ("file", ""))
        spec = DatasetSpec(name, *source)
        plain = {k: entry[k] for k in ("formatting", "ranking", "subset", "split", "folder", "num_samples") if k in entry}
        blocks = {}
        for block, defaults in (("columns", COLUMN_DEFAULTS), ("tags", TAG_DEFAULTS)):
            if block in entry:
                blocks.update({k: entry[block].get(k) for k in defaults if k in known})
        out.append(replace(spec, **plain, **blocks))
    return out


def resolve_table(registry: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same resolution over a registry table (name, formatting, ranking, columns map, tags map, urls, ...).

    Returns the resolved rows and the wanted names that are undefined.
    """
    found = wanted.join(registry, "name")
    missing = wanted.join(registry, "name", "left_anti")

    def pick(block: str, key: str, default: str | None):
        # A missing block keeps the default; a present block yields its entry or null.
        return F.when(F.col(block).isNull(), F.lit(default).cast("string")).otherwise(F.col(block)[key]).alias(key)

    urls = F.lit(None).cast("string")
    kind = F.lit("file")
    for key, source in reversed(SOURCE_KEYS):
        if key in registry.columns:
            urls = F.when(F.col(key).isNotNull(), F.col(key)).otherwise(urls)
            kind = F.when(F.col(key).isNotNull(), F.lit(source)).otherwise(kind)
    resolved = found.select(
        "name", kind.alias("load_from"), urls.alias("location"),
        F.coalesce("formatting", F.lit("alpaca")).alias("formatting"),
        F.coalesce("ranking", F.lit(False)).alias("ranking"),
        F.coalesce("split", F.lit("train")).alias("split"),
        *[pick("columns", k, v) for k, v in COLUMN_DEFAULTS.items()],
        *[pick("tags", k, v) for k, v in TAG_DEFAULTS.items()])
    return resolved, missing


def usable_for(registry: DataFrame, stage: str) -> DataFrame:
    """Datasets a training stage can use: ranking sets for pair stages, the others for the rest."""
    return registry.filter(F.coalesce(F.col("ranking"), F.lit(False)) == F.lit(stage in PAIR_STAGES))


def check_stage(spec: DatasetSpec, stage: str) -> None:
    if (stage == "rm") != bool(spec.ranking):
        raise ValueError(f"dataset {spec.name} (ranking={spec.ranking}) cannot be used in stage {stage}")
