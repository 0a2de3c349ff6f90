"""Media references in chats: paths, placeholder counts, placeholder expansion, and resize and frame plans from a
manifest. No pixels are read."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prefmill.functions.numeric import IGNORE, let
from prefmill.functions.text import occurrences
from prefmill.operators.joins import PER_COPY, join_measured

# Placeholders per kind.
PLACEHOLDERS = {"image": "<image>", "video": "<video>", "audio": "<audio>"}


@dataclass(frozen=True)
class MediaRule:
    """How a model family shows a medium: the token, marks around it, and its shape. ``counted``: every file has its own token
    count; ``uniform``: all have the same; ``grid``: rows of patches that end in ``row_end``, the last in ``after``;
    ``tiled``: the count follows from the size; ``prefix``: all tokens stand before the text."""
    kind: str
    token: str
    before: str = ""
    after: str = ""
    shape: str = "counted"
    row_end: str = ""
    patch: int = 16


MEDIA_RULES: dict[str, MediaRule] = {}


def register_media_rule(name: str, rule: MediaRule) -> MediaRule:
    if name in MEDIA_RULES:
        raise ValueError(f"media rule {name} already exists")
    MEDIA_RULES[name] = rule
    return rule


# Token and marks.
register_media_rule("llava", MediaRule("image", "<image>", shape="uniform"))
register_media_rule("qwen2_vl", MediaRule("image", "<|image_pad|>", "<|vision_start|>", "<|vision_end|>"))
register_media_rule("qwen2_vl_video", MediaRule("video", "<|video_pad|>", "<|vision_start|>", "<|vision_end|>"))
register_media_rule("llava_next", MediaRule("image", "<image>", shape="tiled"))
register_media_rule("llava_next_video", MediaRule("video", "<video>"))
register_media_rule("video_llava", MediaRule("video", "<video>"))
register_media_rule("lfm2_vl", MediaRule("image", "<image>"))
register_media_rule("mllama", MediaRule("image", "<|image|>", shape="uniform"))
register_media_rule("gemma3", MediaRule("image", "<image_soft_token>", "\n\n<start_of_image>", "<end_of_image>\n\n"))
register_media_rule("gemma3n_audio", MediaRule("audio", "<audio_soft_token>", "\n\n<start_of_audio>", "<end_of_audio>\n\n"))
register_media_rule("intern_vl", MediaRule("image", "<IMG_CONTEXT>", "<img>", "</img>"))
register_media_rule("kimi_vl", MediaRule("image", "<|media_pad|>", "<|media_start|>image<|media_content|>", "<|media_end|>"))
register_media_rule("glm4v", MediaRule("image", "<|image|>", "<|begin_of_image|>", "<|end_of_image|>"))
register_media_rule("qwen2_audio", MediaRule("audio", "<|AUDIO|>", "<|audio_bos|>", "<|audio_eos|>"))
register_media_rule("qwen2_omni_audio", MediaRule("audio", "<|AUDIO|>", "<|audio_start|>", "<|audio_end|>"))
register_media_rule("paligemma", MediaRule("image", "<image>", shape="prefix"))
register_media_rule("pixtral", MediaRule("image", "[IMG]", after="[IMG_END]", shape="grid", row_end="[IMG_BREAK]"))


def list_files(spark: SparkSession, folder: str, column: str = "path") -> DataFrame:
    """Paths (or lengths) of the files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(column)


def media_resolve(df: DataFrame, key: str, paths: str, listing: DataFrame, folder: str, per_copy: int = PER_COPY) -> DataFrame:
    """key, resolved paths in order, number of missing files. A path found below ``folder`` gets that prefix, others stay;
    a row without media keeps an empty list.
    ``paths`` is a list of files or, for videos given as frames, a list of lists.

    One path may be used by a large share of the rows: uses are counted, and a path's entry is copied as often as its uses
    ask for.
    """
    framed = dict(df.dtypes)[paths].startswith("array<array")
    spread = df.select(key, F.posexplode_outer(paths).alias("pos", "path"))
    spread = spread.select(key, "pos", F.posexplode_outer("path").alias("frame", "path")) if framed else spread.withColumn("frame", F.lit(0))
    spread = spread.withColumn("_full", F.concat(F.lit(folder.rstrip("/") + "/"), "path"))
    known = listing.select(F.col("path").alias("_full")).distinct().withColumn("_found", F.lit(True))
    used = spread.filter("path IS NOT NULL")
    # Rows without a path have nothing to find and never meet in one task.
    joined = join_measured(used, known, ["_full"], [key, "pos", "frame"], per_copy).unionByName(
        spread.filter("path IS NULL").withColumn("_found", F.lit(None).cast("boolean")))
    held = F.col("path").isNotNull()
    cell = F.when(held, F.struct("pos", "frame", F.when(F.col("_found"), F.col("_full")).otherwise(F.col("path")).alias("path")))
    out = joined.groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("_cells"), F.sum((held & F.col("_found").isNull()).cast("bigint")).alias("missing"))
    flat = F.transform("_cells", lambda x: x["path"])
    last = F.array_max(F.transform("_cells", lambda x: x["pos"]))
    nested = F.transform(F.when(last.isNotNull(), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda p: F.transform(F.filter("_cells", lambda x: x["pos"] == p), lambda x: x["path"]))
    return out.select(key, (nested if framed else flat).alias(paths), "missing")


def placeholder_count(messages: Column, kind: str) -> Column:
    return F.aggregate(messages, F.lit(0), lambda n, m: n + occurrences(m["content"], PLACEHOLDERS[kind]))


def media_count_check(df: DataFrame, messages: str, columns: dict[str, str]) -> DataFrame:
    """Adds <kind>_ok per kind: as many files as placeholders. A missing list counts as empty."""
    checks = {}
    for kind, name in columns.items():
        files = F.coalesce(F.size(F.col(name)), F.lit(0))
        checks[f"{kind}_ok"] = placeholder_count(F.col(messages), kind) == F.greatest(files, F.lit(0))
    return df.withColumns(checks)


#: Between messages and for itself while a conversation is one text.
_MARK = "\u0001"


def media_fill(messages: Column, shown: Column, kind: str = "image") -> Column:
    """Replace the k-th placeholder of the conversation by shown[k]; nothing stands for a placeholder beyond the list.

    All messages are split into pieces at once. A message has one piece more than placeholders, so the number of pieces and of
    messages before a piece tells how many placeholders came before: nothing is counted again, and the work is linear in the
    conversation.
    """
    def pieces(m, i):
        content = F.replace(F.coalesce(m["content"], F.lit("")), F.lit(_MARK), F.lit(_MARK + "0"))
        return F.transform(F.split(content, PLACEHOLDERS[kind], -1), lambda p, j: F.struct(i.alias("i"), j.alias("j"), p.alias("p")))

    def filled(x, f):
        new = F.replace(F.coalesce(F.get(shown, f - x["i"] - 1), F.lit("")), F.lit(_MARK), F.lit(_MARK + "0"))
        return F.when(x["j"] > 0, F.concat(new, x["p"])).when(x["i"] > 0, F.concat(F.lit(_MARK + "1"), x["p"])).otherwise(x["p"])
    text = F.array_join(F.transform(F.flatten(F.transform(messages, pieces)), filled), "")
    contents = F.split(text, _MARK + "1", -1)
    return F.when(F.size(messages) == 0, messages).otherwise(F.zip_with(messages, contents, lambda m, c: F.struct(
        m["role"].alias("role"), F.when(m["content"].isNotNull(), F.replace(c, F.lit(_MARK + "0"), F.lit(_MARK))).alias("content"))))


def media_expand(messages: Column, counts: Column, token: str, kind: str = "image", before: str = "", after: str = "") -> Column:
    """Replace the k-th placeholder of the conversation by before + token repeated counts[k] times + after; a placeholder
    without a count keeps the marks alone."""
    shown = F.transform(counts, lambda n: F.concat(F.lit(before), F.repeat(F.lit(token), F.coalesce(n, F.lit(0))), F.lit(after)))
    rest = F.greatest(placeholder_count(messages, kind) - F.size(counts), F.lit(0))
    return media_fill(messages, F.concat(shown, F.array_repeat(F.lit(before + after), rest)), kind)


def media_expand_uniform(messages: Column, count: Column, token: str, kind: str = "image") -> Column:
    """Every placeholder becomes the same number of tokens."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.replace(
        m["content"], F.lit(PLACEHOLDERS[kind]), F.repeat(F.lit(token), count)).alias("content")))


def grid_text(width: Column, height: Column, patch: int, token: str, row_end: str, end: str) -> Column:
    """An image as rows of tokens: one token per whole patch, a mark after every row, the last one another. An image lower
    than a patch shows nothing."""
    row, rows = F.repeat(F.lit(token), F.floor(width / patch).cast("int")), F.floor(height / patch).cast("int")
    return F.when(rows > 0, F.concat(F.repeat(F.concat(row, F.lit(row_end)), rows - 1), row, F.lit(end))).otherwise(F.lit(""))


def media_grid(messages: Column, sizes: Column, patch: int, token: str, row_end: str, end: str) -> Column:
    """Images as token grids; ``sizes``: array of (w, h) in the order of the placeholders."""
    return media_fill(messages, F.transform(sizes, lambda s: grid_text(s["w"], s["h"], patch, token, row_end, end)))


def media_without_marks(messages: Column, kind: str = "image") -> Column:
    """For families that put all images in front: placeholders vanish from the text."""
    return media_fill(messages, F.array().cast("array<string>"), kind)


def media_prefix(ids: Column, labels: Column, images: Column, per_image: int, token_id: int) -> tuple[Column, Column]:
    """Token ids and labels with ``per_image`` tokens for each image in front, which no loss sees."""
    count = F.coalesce(images, F.lit(0)).cast("int") * per_image
    return F.concat(F.array_repeat(F.lit(token_id), count), ids), F.concat(F.array_repeat(F.lit(IGNORE), count), labels)


# Resolutions (height, width) that a tiled image may take, side of a tile and of a patch.
TILINGS = ((336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008))
TILE, PATCH = 336, 14


def tiled_tokens(width: Column, height: Column, tilings=TILINGS, tile: int = TILE, patch: int = PATCH) -> Column:
    """Tokens of an image that is shown whole and again in tiles: patches of one tile, patches of the tiled image without the
    padding its shape leaves, and one row end per row of patches.

    The tiling is the one that keeps most pixels, of those the one that wastes least, of those the first.
    """
    def fit(i, tall, wide):
        scale = F.least(wide / width, tall / height)
        kept = F.least(F.floor(width * scale) * F.floor(height * scale), (width * height).cast("bigint"))
        return F.struct(kept.alias("kept"), (kept - tall * wide).alias("waste"), F.lit(-i).alias("i"), F.lit(tall).alias("tall"), F.lit(wide).alias("wide"))
    side = tile // patch

    def count(best):
        rows, columns = F.floor(best["tall"] / tile) * side, F.floor(best["wide"] / tile) * side
        low = rows - 2 * F.floor((rows - F.floor(F.round(height * (columns / width), 7))) / 2)
        narrow = columns - 2 * F.floor((columns - F.floor(F.round(width * (rows / height), 7))) / 2)
        flat = width / height > columns / rows
        rows, columns = F.when(flat, low).otherwise(rows), F.when(flat, columns).otherwise(narrow)
        return (rows * columns + rows + side * side).cast("bigint")
    return let(F.array_max(F.array(*[fit(i, *t) for i, t in enumerate(tilings)])), count)


def expand_by_rule(messages: Column, counts: Column, name: str) -> Column:
    """Expansion as a registered rule says; a uniform rule uses the first count for every placeholder, a grid rule takes
    (w, h) cells for counts, a tiled rule as well, and a prefix rule takes the placeholders out (see ``media_prefix``)."""
    rule = MEDIA_RULES[name]
    if rule.shape == "grid":
        return media_grid(messages, counts, rule.patch, rule.token, rule.row_end, rule.after)
    if rule.shape == "prefix":
        return media_without_marks(messages, rule.kind)
    if rule.shape == "tiled":
        counts = F.transform(counts, lambda s: tiled_tokens(s["w"], s["h"]).cast("int"))
    if rule.shape == "uniform":
        return media_expand_uniform(messages, F.coalesce(F.get(counts, F.lit(0)), F.lit(0)), rule.token, rule.kind)
    return media_expand(messages, counts, rule.token, rule.kind, rule.before, rule.after)


def media_resize_plan(df: DataFrame, max_pixels: int, min_pixels: int, width: str = "w", height: str = "h",
                      min_side: int = 28, max_aspect: int = 200, capped_aspect: int = 180) -> DataFrame:
    """Adds new_w, new_h: scaled into the pixel range, then at least ``min_side`` on each side, then the aspect capped."""
    out = df.withColumn("new_w", F.col(width).cast("bigint")).withColumn("new_h", F.col(height).cast("bigint"))
    w, h = F.col("new_w"), F.col("new_h")

    def scaled(when, target):
        factor = F.sqrt(F.try_divide(F.lit(float(target)), w * h))
        return {n: F.when(when, F.floor(x * factor)).otherwise(x) for n, x in (("new_w", w), ("new_h", h))}

    out = out.withColumns(scaled(w * h > max_pixels, max_pixels))
    out = out.withColumns(scaled(w * h < min_pixels, min_pixels))
    small = F.least(w, h) < min_side
    out = out.withColumns({n: F.when(small, F.greatest(x, F.lit(min_side))).otherwise(x) for n, x in (("new_w", w), ("new_h", h))})
    out = out.withColumn("new_w", F.when(F.try_divide(w, h) > max_aspect, h * capped_aspect).otherwise(w))
    return out.withColumn("new_h", F.when(F.try_divide(h, w) > max_aspect, w * capped_aspect).otherwise(h))


def video_frame_plan(total: Column, duration: Column, fps: float = 2.0, max_frames: int = 128) -> Column:
    """Frame numbers to read: evenly spaced over the video; a video of unknown length gives the first max_frames."""
    wanted = F.least(total, F.lit(max_frames), F.greatest(F.lit(1), F.floor(duration * fps))).cast("int")
    steps = F.sequence(F.lit(0), F.greatest(wanted - 1, F.lit(0)))
    gap = F.try_divide((total - 1).cast("double"), (wanted - 1).cast("double"))
    spaced = F.transform(steps, lambda i: F.when(i == 0, 0).when(i == wanted - 1, total - 1).otherwise(F.floor(i * gap)).cast("int"))
    return F.when(total == 0, F.sequence(F.lit(0), F.lit(max_frames - 1))).otherwise(spaced)
