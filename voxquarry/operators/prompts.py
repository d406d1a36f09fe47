"""Prompt tables: modes, variants, inventories, atlas priors, hard negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab
from ..session import cut_lineage
from .ordering import global_rank
from .voxels import TARGET

TARGET_KEYS = TARGET


def _tagged(pairs: list[tuple[str, Column]], tag: str, value: str) -> Column:
    return F.array(*[F.struct(F.lit(n).alias(tag), c.alias(value)) for n, c in pairs])


def _explode_tagged(df: DataFrame, pairs, tag: str, value: str) -> DataFrame:
    return df.withColumn("_t", F.explode(_tagged(pairs, tag, value))).withColumns(
        {tag: F.col(f"_t.{tag}"), value: F.col(f"_t.{value}")}
    ).drop("_t")


def prompt_modes(targets: DataFrame, text: str = "text") -> DataFrame:
    """Every target once with its own text and once with its finding term."""
    raw = tx.strip(F.col(text))
    return _explode_tagged(
        targets, [("raw", raw), ("structured", tx.finding_regex(raw))], "mode", "prompt"
    )


def text_variants(targets: DataFrame, text: str = "text") -> DataFrame:
    """Rows for the raw, shortened and keyword form of every text."""
    t = F.col(text)
    return _explode_tagged(
        targets, [("raw", t), ("short", tx.shorten_text(t)), ("keyword", tx.anatomy_keyword(t))],
        "variant", "prompt",
    )


def prompt_format_variants(targets: DataFrame, text: str = "text") -> DataFrame:
    """Raw text, its short keyword (if any matches) and its first sentence."""
    t = F.col(text)
    pairs = [
        ("raw_full", t),
        ("short_kw", tx.short_keyword(t, vocab.SHORT_KEYWORDS_VARIANT, default=None)),
        ("first_sent", tx.first_sentence(t)),
    ]
    return _explode_tagged(targets, pairs, "variant", "prompt").where(F.col("prompt").isNotNull())


def prompt_inventory(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Distinct prompts with a dense 0-based id in text order."""
    distinct = cut_lineage(prompts.select(prompt).distinct())
    ranked = global_rank(distinct, [prompt], "prompt_id")
    return ranked.withColumn("prompt_id", F.col("prompt_id") - 1)


def embed_join(prompts: DataFrame, inventory: DataFrame, vectors: DataFrame) -> DataFrame:
    """Attach the cached vector of every prompt through its inventory id; no vector yet: NULL."""
    keyed = inventory.join(vectors, "prompt_id", "left")
    return prompts.join(keyed, "prompt", "left")


ATLAS_FIELDS = ["z_min", "z_max", "y_min", "x_min", "y_max", "x_max"]


def atlas_table(spark, atlas=vocab.ATLAS) -> DataFrame:
    """The spatial atlas as rows; its size is that of the dictionary."""
    return spark.createDataFrame(
        [(k, *map(float, v)) for k, v in atlas.items()],
        "anatomy string, " + ", ".join(f"atlas_{f} double" for f in ATLAS_FIELDS),
    )


def atlas_prior(packets: DataFrame, atlas: dict = vocab.ATLAS) -> DataFrame:
    """Append the atlas range of the organ, narrowed to the half of the given side.

    The dictionary is broadcast: it is a literal of this program, not data.
    """
    table = F.broadcast(atlas_table(packets.sparkSession, atlas))
    joined = packets.join(table, "anatomy", "left")
    default = dict(zip(ATLAS_FIELDS, atlas["unknown"]))
    ext = {f: F.coalesce(F.col(f"atlas_{f}"), F.lit(float(default[f]))) for f in ATLAS_FIELDS}
    narrow = ~F.col("anatomy").isin(vocab.SIDE_EXEMPT_ANATOMY)
    for side, (lo, hi) in vocab.SIDE_X_RANGE.items():
        hit = narrow & (F.col("side") == side)
        ext["x_min"] = F.when(hit, F.greatest(ext["x_min"], F.lit(lo))).otherwise(ext["x_min"])
        ext["x_max"] = F.when(hit, F.least(ext["x_max"], F.lit(hi))).otherwise(ext["x_max"])
    return joined.withColumns({f"atlas_{f}": c for f, c in ext.items()})


def _phrase(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.when(~p.isin("", "none", "unknown"), F.replace(p, F.lit("_"), F.lit(" "))) for p in parts])


def prompt_bank_variants(packets: DataFrame, text: str = "text") -> DataFrame:
    """Four wordings of one target: where, what and where, short, full."""
    side, level = F.col("side"), F.col("level")
    organ, what = F.col("anatomy"), F.col("finding_type")
    many = F.when(F.col("count") == "multiple", F.lit("multiple")).otherwise(F.lit(""))
    form = F.when(F.col("target_form") == "diffuse", F.lit("diffuse")).otherwise(F.lit(""))
    pairs = [
        ("location", _phrase(side, level, organ)),
        ("anatomy_finding", _phrase(side, organ, what)),
        ("short", _phrase(many, form, side, level, organ, what)),
        ("full", F.col(text)),
    ]
    return _explode_tagged(packets, pairs, "variant", "prompt")


def flip_laterality(text: Column) -> Column:
    """Swap left and right through a placeholder that text never holds."""
    hold = F.lit("\u0001")
    swapped = F.replace(text, F.lit("left"), hold)
    swapped = F.replace(swapped, F.lit("right"), F.lit("left"))
    return F.replace(swapped, hold, F.lit("right"))


def hard_negatives(packets: DataFrame, text: str = "text") -> DataFrame:
    """Misleading texts for every target: wrong side, wrong place, sibling target.

    Partners are one per target: the next target of the same case (cyclic), and the
    next place (by name, cyclic) known for the same finding.  Pairs of a group
    are never enumerated.
    """
    t = F.col(text)
    base = packets.select(*TARGET, "anatomy", "finding_type", text)
    flip = base.where(F.col("anatomy").isNotNull() & (flip_laterality(t) != t)).select(
        *TARGET, F.lit("laterality_flip").alias("kind"), flip_laterality(t).alias("negative")
    )
    # Places per finding: at most the canonical vocabulary, so the array is bounded.
    places = base.groupBy("finding_type").agg(F.array_sort(F.collect_set("anatomy")).alias("places"))
    at = F.array_position("places", F.col("anatomy")).cast("int")
    other = F.get("places", F.pmod(at, F.size("places")))
    moved = (
        base.join(places, "finding_type")
        .where(F.size("places") > 1)
        .select(*TARGET, F.lit("same_finding_elsewhere").alias("kind"), F.concat_ws(" ", other, "finding_type").alias("negative"))
    )
    # The next target id that the case has, after the last one the first again.
    order = Window.partitionBy("case_id").orderBy("mask_id")
    whole = Window.partitionBy("case_id")
    ahead = F.coalesce(F.lead("mask_id").over(order), F.min("mask_id").over(whole))
    pairs = base.select(*TARGET).distinct().withColumn("_next", ahead).where("_next <> mask_id")
    nxt = base.select("case_id", F.col("mask_id").alias("_next"), F.col(text).alias("negative"))
    sibling = pairs.join(nxt, ["case_id", "_next"]).select(*TARGET, F.lit("sibling").alias("kind"), "negative")
    return flip.unionByName(moved).unionByName(sibling)


def difficulty_tags(targets: DataFrame, small: int = 500) -> DataFrame:
    """small / diffuse / bony / ambiguous tags as one sorted comma list."""
    tags = [
        ("ambiguous", (F.col("anatomy") == "unknown") | (F.col("finding_type") == "lesion")),
        ("bony", F.col("target_form") == "bony"),
        ("diffuse", F.col("target_form").isin("diffuse", "multifocal")),
        ("small", (F.col("gt_voxels") > 0) & (F.col("gt_voxels") < small)),
    ]
    return targets.withColumn("tags", F.concat_ws(",", *[F.when(c, n) for n, c in tags]))
