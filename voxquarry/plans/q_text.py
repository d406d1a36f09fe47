"""Queries: text slots, prompts, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab
from ..operators import boxes as bx
from ..operators import prompts as pr
from ..operators import retrieval as rt
from ..operators import tfidf as tf
from ..session import cut_lineage, shuffled
from .fixtures import D, H, STOP_WORDS, W
from .registry import query, rounded

T = ["case_id", "mask_id"]


# Checking SQL uses ordered lookup rows and a minimum, not a CASE ladder.
def _first(pairs, default: str, test: str = "contains(lower(text), kw)") -> str:
    rows = ", ".join(f"({i}, '{k}', '{c}')" for i, (k, c) in enumerate(pairs))
    return f"coalesce((SELECT arg_min(canon, ord) FROM (VALUES {rows}) v(ord, kw, canon) WHERE {test}), '{default}')"


WORD = r"regexp_matches(lower(text), concat('\b', kw, '\b'))"
ANATOMY = _first(vocab.ANATOMY_KEYWORDS, "unknown")
FINDING = _first(vocab.FINDING_KEYWORDS, "lesion")
SPINE = _first([(s.lower(), s) for s in vocab.SPINE_LEVELS], "", WORD)
SIDE = """CASE WHEN regexp_matches(lower(text), 'bilateral|both') OR (lower(text) LIKE '%left%' AND lower(text) LIKE '%right%') THEN 'bilateral'
   WHEN lower(text) LIKE '%left%' THEN 'left' WHEN lower(text) LIKE '%right%' THEN 'right' ELSE 'none' END"""
COUNT = "CASE WHEN regexp_matches(lower(text), 'multiple|several|numerous|bilateral|both') THEN 'multiple' ELSE 'single' END"
LEVEL = """CASE WHEN anatomy IN ('lung', 'kidney') AND regexp_matches(lower(text), 'upper|apex') THEN 'upper'
   WHEN anatomy IN ('lung', 'kidney') AND regexp_matches(lower(text), 'lower|base') THEN 'lower'
   WHEN anatomy IN ('lung', 'kidney') AND lower(text) LIKE '%middle%' THEN 'middle' ELSE spine END"""
BASE_FORM = """CASE WHEN anatomy IN ('spine', 'bone') OR finding_type IN ('osteophyte', 'spondylosis', 'fracture') THEN 'bony'
   WHEN regexp_matches(lower(text), 'diffuse|scattered') OR finding_type = 'emphysema' THEN 'diffuse'
   WHEN "count" = 'multiple' AND finding_type <> 'mass' THEN 'multifocal' ELSE 'focal' END"""
PACKET = f"""pk0 AS (SELECT *, {ANATOMY} AS anatomy, {FINDING} AS finding_type, {SPINE} AS spine, {SIDE} AS side, {COUNT} AS "count" FROM descr),
   pk1 AS (SELECT *, {LEVEL} AS level, {BASE_FORM} AS form0, finding_type IN ('enlargement', 'cirrhosis', 'ascites') AS organ FROM pk0),
   packet AS (SELECT *, CASE WHEN organ THEN 'diffuse' ELSE form0 END AS target_form,
     CASE WHEN organ THEN 'organ_roi' WHEN form0 = 'focal' THEN 'keep_nearest' ELSE 'keep_multi' END AS post_rule FROM pk1)"""


def _slot_query(name: str, expr):
    sql = f"WITH {PACKET} SELECT doc_id, {name[1]} FROM packet"

    @query(name[0], sql)
    def _(d):
        return expr(d)


def packets(d):
    return tx.with_packet(d.descr)


@query("kw_first", f"SELECT doc_id, {ANATOMY} AS anatomy, {FINDING} AS finding_type FROM documents")
def _(d):
    t = F.col("text")
    return d.table("documents").select("doc_id", tx.anatomy(t).alias("anatomy"), tx.finding(t).alias("finding_type"))


@query("laterality", f"SELECT doc_id, {SIDE} AS side FROM documents")
def _(d):
    return d.table("documents").select("doc_id", tx.laterality(F.col("text")).alias("side"))


@query("spine_level", f"SELECT doc_id, {SPINE} AS level FROM descr")
def _(d):
    return d.descr.select("doc_id", tx.spine_level(F.col("text")).alias("level"))


for _name, _column in [
    ("organ_level", "level"), ("count_focality", '"count"'), ("target_form_route", "target_form"), ("post_rule_route", "post_rule"),
]:

    def _make(column):
        return lambda d: packets(d).select("doc_id", column.strip('"'))

    _slot_query((_name, _column), _make(_column))


@query("parse_packet", f'WITH {PACKET} SELECT doc_id, anatomy, side, level, target_form, finding_type, "count", post_rule FROM packet')
def _(d):
    return tx.parse_packet(d.descr).select("doc_id", "packet.*")


REGEX = _first([(t, vocab.FINDING_SINGULAR.get(t, t)) for t in vocab.FINDING_TERMS], "lesion", WORD)


@query("finding_regex", f"SELECT doc_id, {REGEX} AS finding FROM descr")
def _(d):
    return d.descr.select("doc_id", tx.finding_regex(F.col("text")).alias("finding"))


@query("short_keyword", f"SELECT doc_id, {_first([(w, w) for w in vocab.SHORT_KEYWORDS], 'lesion')} AS kw FROM descr")
def _(d):
    return d.descr.select("doc_id", tx.short_keyword(F.col("text")).alias("kw"))


FIRST_SENT = r"regexp_replace(split_part(text, '.', 1), '^\s+|\s+$', '', 'g') || '.'"


@query("first_sentence", f"SELECT doc_id, {FIRST_SENT} AS s FROM documents")
def _(d):
    return d.table("documents").select("doc_id", tx.first_sentence(F.col("text")).alias("s"))


_BARE = r"regexp_replace(text, '\([^)]*\)', '', 'g')"
for _p in vocab.FILLER_PHRASES:
    _BARE = f"replace({_BARE}, '{_p}', '')"
SHORT = rf"""sh0 AS (SELECT *, regexp_replace({_BARE}, '^\s+|\s+$', '', 'g') AS b FROM SRC),
   sh1 AS (SELECT *, CASE WHEN length(b) > 80 THEN regexp_replace(split_part(b, ',', 1), '^\s+|\s+$', '', 'g') ELSE b END AS c FROM sh0),
   sh2 AS (SELECT *, list_filter(regexp_split_to_array(c, '\s+'), lambda v : v <> '') AS w FROM sh1),
   shortened AS (SELECT *, CASE WHEN len(w) > 15 THEN array_to_string(w[1:15], ' ') ELSE c END AS short FROM sh2)"""


@query("shorten_text", f"WITH {SHORT.replace('SRC', 'documents')} SELECT doc_id, short FROM shortened")
def _(d):
    return d.table("documents").select("doc_id", tx.shorten_text(F.col("text")).alias("short"))


_TERM_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(vocab.ANATOMY_TERMS))
KEYWORD = rf"""coalesce((SELECT arg_min(kw, ord - 1000 * length(kw)) FROM (VALUES {_TERM_ROWS}) v(ord, kw) WHERE contains(lower(text), kw)),
   array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda v : v <> '')[1:5], ' '))"""


@query("anatomy_keyword", f"SELECT doc_id, {KEYWORD} AS kw FROM documents")
def _(d):
    return d.table("documents").select("doc_id", tx.anatomy_keyword(F.col("text")).alias("kw"))


@query(
    "text_variants",
    f"""WITH {SHORT.replace('SRC', 'descr')} SELECT doc_id, 'raw' AS variant, text AS prompt FROM descr
        UNION ALL SELECT doc_id, 'short', short FROM shortened UNION ALL SELECT doc_id, 'keyword', {KEYWORD} FROM descr""",
)
def _(d):
    return pr.text_variants(d.descr).select("doc_id", "variant", "prompt")


_KW2 = ", ".join(f"({i}, '{t}')" for i, t in enumerate(vocab.SHORT_KEYWORDS_VARIANT))


@query(
    "prompt_format_variants",
    f"""SELECT doc_id, 'raw_full' AS variant, text AS prompt FROM descr UNION ALL SELECT doc_id, 'first_sent', {FIRST_SENT} FROM descr
        UNION ALL SELECT doc_id, 'short_kw', (SELECT arg_min(kw, ord) FROM (VALUES {_KW2}) v(ord, kw) WHERE contains(lower(text), kw)) AS k FROM descr
          WHERE regexp_matches(lower(text), '{'|'.join(vocab.SHORT_KEYWORDS)}')""",
)
def _(d):
    return pr.prompt_format_variants(d.descr).select("doc_id", "variant", "prompt")


MODES = f"SELECT case_id, mask_id, 'raw' AS mode, text AS prompt FROM descr UNION ALL SELECT case_id, mask_id, 'structured', {REGEX} FROM descr"


@query("prompt_modes", MODES)
def _(d):
    return pr.prompt_modes(d.descr).select(*T, "mode", "prompt")


@query(
    "prompt_inventory",
    f"WITH m AS ({MODES}), u AS (SELECT DISTINCT prompt FROM m) SELECT prompt, row_number() OVER (ORDER BY prompt COLLATE \"C\") - 1 AS prompt_id FROM u",
)
def _(d):
    return pr.prompt_inventory(pr.prompt_modes(d.descr))


@query(
    "embed_join",
    f"""WITH m AS ({MODES}), u AS (SELECT prompt, row_number() OVER (ORDER BY prompt COLLATE "C") - 1 AS prompt_id FROM (SELECT DISTINCT prompt FROM m))
        SELECT m.case_id, m.mask_id, m.mode, u.prompt_id, round(cast(e.embedding[1] AS double), 6) AS e0 FROM m JOIN u ON m.prompt = u.prompt LEFT JOIN embeddings e ON e.vec_id = u.prompt_id""",
)
def _(d):
    prompts = pr.prompt_modes(d.descr).select(*T, "mode", "prompt")
    vec = d.table("embeddings").select(F.col("vec_id").alias("prompt_id"), "embedding")
    j = pr.embed_join(prompts, pr.prompt_inventory(prompts), vec)
    return rounded(j.select(*T, "mode", "prompt_id", F.get("embedding", F.lit(0)).cast("double").alias("e0")))


# --- priors -------------------------------------------------------------------

_ATLAS_ROWS = ", ".join(f"('{k}', {', '.join(f'{x}::double' for x in v)})" for k, v in vocab.ATLAS.items())
ATLAS = f"""{PACKET}, at0 AS (SELECT p.*, z_min, z_max, y_min, y_max,
     CASE WHEN side = 'left' AND p.anatomy NOT IN ('spine', 'bone', 'aorta') THEN greatest(x_min, 0.5) WHEN side = 'right' AND p.anatomy NOT IN ('spine', 'bone', 'aorta') THEN greatest(x_min, 0.0) ELSE x_min END AS x_min,
     CASE WHEN side = 'right' AND p.anatomy NOT IN ('spine', 'bone', 'aorta') THEN least(x_max, 0.5) ELSE x_max END AS x_max
   FROM packet p JOIN (VALUES {_ATLAS_ROWS}) a(organ, z_min, z_max, y_min, x_min, y_max, x_max)
     ON a.organ = CASE WHEN p.anatomy IN ({', '.join(repr(k) for k in vocab.ATLAS)}) THEN p.anatomy ELSE 'unknown' END)"""
EXT = rt.EXTENT


@query("atlas_prior", f"WITH {ATLAS} SELECT case_id, mask_id, {', '.join(f'round({e}, 6) AS atlas_{e}' for e in EXT)} FROM at0")
def _(d):
    return rounded(pr.atlas_prior(packets(d)).select(*T, *[f"atlas_{e}" for e in EXT]))


BANK = f"""bank AS (SELECT t.case_id, t.mask_id, t.pos, t.text, coalesce(n, 0) AS gt_voxels,
   {', '.join(f'coalesce(b.{e}, -1) AS {e}' for e in EXT)} FROM descr t LEFT JOIN
   (SELECT case_id, mask_id, count(*) AS n, min(z) / {D}.0::double AS z_min, max(z) / {D}.0::double AS z_max, min(y) / {H}.0::double AS y_min, max(y) / {H}.0::double AS y_max,
     min(x) / {W}.0::double AS x_min, max(x) / {W}.0::double AS x_max FROM gt GROUP BY case_id, mask_id) b ON t.case_id = b.case_id AND t.mask_id = b.mask_id)"""


def bank_of(d):
    return rt.prompt_bank(d.descr.drop("doc_id"), d.gt, D, H, W)


@query("prompt_bank", f"WITH {BANK} SELECT case_id, mask_id, gt_voxels, {', '.join(f'round({e}, 6) AS {e}' for e in EXT)} FROM bank")
def _(d):
    return rounded(bank_of(d).select(*T, "gt_voxels", *EXT))


@query(
    "prompt_bank_pixels",
    """SELECT t.case_id, t.mask_id, coalesce(n, 0) AS gt_voxels, coalesce(z0, -1) AS z_min, coalesce(x1, -1) AS x_max FROM descr t LEFT JOIN
       (SELECT case_id, mask_id, count(*) AS n, min(z) AS z0, max(x) AS x1 FROM gt GROUP BY case_id, mask_id) b ON t.case_id = b.case_id AND t.mask_id = b.mask_id""",
)
def _(d):
    b = rt.prompt_bank(d.descr, d.gt, D, H, W, normalized=False)
    return b.select(*T, "gt_voxels", F.col("z_min").cast("bigint").alias("z_min"), F.col("x_max").cast("bigint").alias("x_max"))


SCORE = """(CASE WHEN q.anatomy = e.anatomy THEN 4 ELSE 0 END + CASE WHEN q.side = e.side THEN 2 WHEN q.side <> 'none' AND e.side <> 'none' THEN -1 ELSE 0 END
   + CASE WHEN q.finding_type = e.finding_type THEN 2 ELSE 0 END + CASE WHEN q.target_form = e.target_form THEN 1 ELSE 0 END
   + CASE WHEN q.level <> '' AND q.level = e.level THEN 2 ELSE 0 END + CASE WHEN q."count" = e."count" THEN 0.5 ELSE 0 END)::double"""


@query(
    "slot_similarity",
    f"""WITH {PACKET} SELECT q.case_id, q.mask_id, {SCORE} AS score FROM packet q JOIN packet e ON q.case_id = e.case_id AND e.mask_id = q.mask_id + 1""",
)
def _(d):
    p = packets(d)
    e = p.select("case_id", (F.col("mask_id") - 1).alias("mask_id"), *[F.col(s).alias("m_" + s) for s in rt.SLOTS])
    return p.join(e, T).select(*T, rt.slot_similarity().alias("score"))


SLOT_TOP = f"""{PACKET}, {BANK}, be AS (SELECT p.*, b.gt_voxels, {', '.join('b.' + e for e in EXT)} FROM packet p JOIN bank b ON p.case_id = b.case_id AND p.mask_id = b.mask_id WHERE b.gt_voxels > 0),
   st0 AS (SELECT q.case_id, q.mask_id, e.case_id AS m_case_id, e.mask_id AS m_mask_id, {SCORE} AS score, {', '.join('e.' + x for x in EXT)},
     row_number() OVER (PARTITION BY q.case_id, q.mask_id ORDER BY {SCORE} DESC, e.case_id, e.pos) AS rank FROM packet q JOIN be e ON q.case_id <> e.case_id),
   slot_top AS (SELECT * FROM st0 WHERE rank <= 5 AND score > 0)"""


def slot_hits(d):
    p = cut_lineage(packets(d))  # texts are parsed once; later filters on slots stay cheap
    bank = p.join(shuffled(bank_of(d).select(*T, "gt_voxels", *EXT)), T)
    return p, rt.slot_topk(p, bank)


@query("slot_topk", f"WITH {SLOT_TOP} SELECT case_id, mask_id, m_case_id, m_mask_id, score, cast(rank AS int) AS rank FROM slot_top")
def _(d):
    return slot_hits(d)[1].select(*T, "m_case_id", "m_mask_id", "score", "rank")


WPRIOR = f"""wprior AS (SELECT case_id, mask_id, {', '.join(f'sum(score * {e}) / nullif(sum(score), 0) AS {e}' for e in EXT)}, avg(score) AS score, count(*) AS matches FROM slot_top GROUP BY case_id, mask_id)"""


@query("weighted_prior", f"WITH {SLOT_TOP}, {WPRIOR} SELECT case_id, mask_id, matches, round(score, 6) AS score, {', '.join(f'round({e}, 6) AS {e}' for e in EXT)} FROM wprior")
def _(d):
    return rounded(rt.weighted_prior(slot_hits(d)[1]))


BLEND = f"""{ATLAS.replace(PACKET, SLOT_TOP)}, {WPRIOR}, blend AS (SELECT a.case_id, a.mask_id, a.post_rule, a.anatomy, a.target_form, w.score,
   {', '.join(f'CASE WHEN w.score >= 3 THEN least(0.9, greatest(0.3, w.score / 10)) * w.{e} + (1 - least(0.9, greatest(0.3, w.score / 10))) * a.{e} ELSE a.{e} END AS {e}' for e in EXT)}
   FROM at0 a LEFT JOIN wprior w ON a.case_id = w.case_id AND a.mask_id = w.mask_id)"""


def blended(d):
    p, hits = slot_hits(d)
    return rt.prior_blend(pr.atlas_prior(p), rt.weighted_prior(hits))


@query("prior_blend", f"WITH {BLEND} SELECT case_id, mask_id, {', '.join(f'round({e}, 8) AS {e}' for e in EXT)} FROM blend")
def _(d):
    return rounded(blended(d).select(*T, *EXT), 8)


# --- TF-IDF -------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
VOCAB_CAP = 5000
TFIDF = rf"""tk AS (SELECT doc_id, case_id, mask_id, list_filter(regexp_extract_all(lower(text), '\b\w\w+\b'), lambda v : v NOT IN ({_STOP})) AS t FROM descr),
   tm AS (SELECT doc_id, unnest(t) AS term FROM tk UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i : t[i] || ' ' || t[i + 1])) FROM tk),
   tfc AS (SELECT doc_id, term, count(*) AS tf FROM tm GROUP BY doc_id, term),
   voc AS (SELECT term, sum(tf) AS ctf, count(*) AS df FROM tfc GROUP BY term ORDER BY ctf DESC, term COLLATE "C" LIMIT {VOCAB_CAP}),
   tw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM descr)) / (1 + df)) + 1) AS w FROM tfc JOIN voc USING (term)),
   tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM tw)"""


@query("tfidf_index", f"WITH {TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def _(d):
    return rounded(tf.tfidf_index(d.descr, STOP_WORDS, VOCAB_CAP))


# Scores are compared after rounding so that both engines break ties alike.
TFIDF_TOP = f"""{TFIDF}, {BANK}, sims AS (SELECT a.doc_id AS q, b.doc_id AS e, sum(a.weight * b.weight) AS s FROM tfidf a JOIN tfidf b USING (term) GROUP BY a.doc_id, b.doc_id),
   cand AS (SELECT q.case_id, q.mask_id, e.case_id AS m_case_id, e.mask_id AS m_mask_id, e.pos AS m_pos, round(coalesce(s, 0), 9) AS score, {', '.join('e.' + x for x in EXT)}
     FROM descr q JOIN bank e ON q.case_id <> e.case_id AND e.gt_voxels > 0 JOIN descr ed ON ed.case_id = e.case_id AND ed.mask_id = e.mask_id LEFT JOIN sims ON sims.q = q.doc_id AND sims.e = ed.doc_id),
   tfidf_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, mask_id ORDER BY score DESC, m_case_id, m_pos) AS rank FROM cand) WHERE rank <= 3)"""


@query("tfidf_topk", f"WITH {TFIDF_TOP} SELECT case_id, mask_id, m_case_id, m_mask_id, round(score, 6) AS score, cast(rank AS int) AS rank FROM tfidf_top")
def _(d):
    hits = tf.tfidf_topk(d.descr, bank_of(d), STOP_WORDS, 3, VOCAB_CAP)
    return rounded(hits.select(*T, "m_case_id", "m_mask_id", "score", "rank"))


@query(
    "tfidf_prior",
    f"""WITH {TFIDF_TOP} SELECT case_id, mask_id, count(*) AS matches, round(avg(score), 6) AS score,
        {', '.join(f'round(sum(score * {e}) / nullif(sum(score), 0), 6) AS {e}' for e in EXT)} FROM tfidf_top GROUP BY case_id, mask_id""",
)
def _(d):
    return rounded(rt.weighted_prior(tf.tfidf_topk(d.descr, bank_of(d), STOP_WORDS, 3, VOCAB_CAP)))


# --- vectors ------------------------------------------------------------------

_QUERY_VEC = """tq AS (SELECT c.case_id, m.mask_id, e.embedding FROM (SELECT DISTINCT case_id FROM emb_slice) c
   CROSS JOIN (SELECT cast(unnest(generate_series(1, 3)) AS bigint) AS mask_id) m
   JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) e ON e.label = (c.case_id + m.mask_id) % 10)"""


@query(
    "cosine_topk",
    f"""WITH {_QUERY_VEC}, s AS (SELECT t.case_id, t.mask_id, s.z, CASE WHEN s.vec_id % 50 = 0 THEN -1.0
          ELSE round(list_cosine_similarity(s.embedding::double[], t.embedding::double[]), 9) END AS sim FROM emb_slice s JOIN tq t ON s.case_id = t.case_id)
        SELECT case_id, mask_id, z, round(sim, 6) AS sim, cast(rank AS int) AS rank FROM
          (SELECT *, row_number() OVER (PARTITION BY case_id, mask_id ORDER BY sim DESC, z) AS rank FROM s) WHERE rank <= 10 AND sim > -0.5""",
)
def _(d):
    vec = d.table("embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    slices = d.emb_slice.withColumn(
        "px", F.when(F.col("vec_id") % 50 == 0, F.array_repeat(F.lit(0.0), 64)).otherwise(F.col("embedding").cast("array<double>"))
    )
    asks = d.emb_slice.select("case_id").distinct().withColumn("mask_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))))
    asks = asks.withColumn("label", ((F.col("case_id") + F.col("mask_id")) % 10).cast("int")).join(vec, "label")
    return rounded(rt.cosine_topk(slices, asks))


@query(
    "size_clamp",
    """WITH s AS (SELECT case_id, mask_id, t AS threshold, count(*) FILTER (WHERE prob > t) AS voxels FROM vox CROSS JOIN (VALUES (0.3::double), (0.5::double), (0.6503::double)) x(t) GROUP BY case_id, mask_id, t),
       p AS (SELECT case_id, mask_id, count(*) AS prior_voxels FROM gt GROUP BY case_id, mask_id)
       SELECT case_id, mask_id, threshold, voxels FROM (SELECT s.*, row_number() OVER (PARTITION BY s.case_id, s.mask_id ORDER BY abs(voxels - prior_voxels), threshold) AS r
         FROM s JOIN p ON s.case_id = p.case_id AND s.mask_id = p.mask_id) WHERE r = 1""",
)
def _(d):
    grid = d.vox.withColumn("threshold", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.6503))))
    sweep = grid.groupBy(*T, "threshold").agg(F.count_if(F.col("prob") > F.col("threshold")).alias("voxels"))
    prior = d.gt.groupBy(*T).agg(F.count(F.lit(1)).alias("prior_voxels"))
    return rt.size_clamp(sweep, prior)


# --- described operators --------------------------------------------------------


@query(
    "prompt_bank_variants",
    f"""WITH {PACKET}, n AS (SELECT *, CASE WHEN side <> 'none' THEN side END AS s, CASE WHEN level <> '' THEN level END AS l, CASE WHEN anatomy <> 'unknown' THEN replace(anatomy, '_', ' ') END AS o,
          CASE WHEN "count" = 'multiple' THEN 'multiple' END AS m, CASE WHEN target_form = 'diffuse' THEN 'diffuse' END AS f FROM packet)
        SELECT doc_id, 'location' AS variant, concat_ws(' ', s, l, o) AS prompt FROM n UNION ALL SELECT doc_id, 'anatomy_finding', concat_ws(' ', s, o, finding_type) FROM n
        UNION ALL SELECT doc_id, 'short', concat_ws(' ', m, f, s, l, o, finding_type) FROM n UNION ALL SELECT doc_id, 'full', text FROM n""",
)
def _(d):
    return pr.prompt_bank_variants(packets(d)).select("doc_id", "variant", "prompt")


@query(
    "hard_negatives",
    f"""WITH {PACKET}, f AS (SELECT case_id, mask_id, text, replace(replace(replace(text, 'left', chr(1)), 'right', 'left'), chr(1), 'right') AS t FROM packet),
        pl AS (SELECT finding_type, anatomy, lead(anatomy) OVER w AS nxt, first_value(anatomy) OVER w AS fst, count(*) OVER (PARTITION BY finding_type) AS n
          FROM (SELECT DISTINCT finding_type, anatomy FROM packet) WINDOW w AS (PARTITION BY finding_type ORDER BY anatomy))
        SELECT case_id, mask_id, 'laterality_flip' AS kind, t AS negative FROM f WHERE t <> text
        UNION ALL SELECT p.case_id, p.mask_id, 'same_finding_elsewhere', coalesce(nxt, fst) || ' ' || p.finding_type FROM packet p JOIN pl ON p.finding_type = pl.finding_type AND p.anatomy = pl.anatomy WHERE n > 1
        UNION ALL SELECT a.case_id, a.mask_id, 'sibling', b.text FROM (SELECT case_id, mask_id, coalesce(lead(mask_id) OVER o, min(mask_id) OVER (PARTITION BY case_id)) AS nx
          FROM packet WINDOW o AS (PARTITION BY case_id ORDER BY mask_id)) a JOIN packet b ON a.case_id = b.case_id AND b.mask_id = a.nx WHERE a.nx <> a.mask_id""",
)
def _(d):
    return pr.hard_negatives(packets(d))


@query(
    "difficulty_tags",
    f"""WITH {PACKET}, {BANK}, j AS (SELECT p.*, gt_voxels FROM packet p JOIN bank b ON p.case_id = b.case_id AND p.mask_id = b.mask_id)
        SELECT case_id, mask_id, concat_ws(',', CASE WHEN anatomy = 'unknown' OR finding_type = 'lesion' THEN 'ambiguous' END, CASE WHEN target_form = 'bony' THEN 'bony' END,
          CASE WHEN target_form IN ('diffuse', 'multifocal') THEN 'diffuse' END, CASE WHEN gt_voxels > 0 AND gt_voxels < 370 THEN 'small' END) AS tags FROM j""",
)
def _(d):
    j = packets(d).join(bank_of(d).select(*T, "gt_voxels"), T)
    return pr.difficulty_tags(j, small=370).select(*T, "tags")


# Boxes proposed by the blended prior, against the truth.
@query(
    "prompt_quality",
    f"""WITH {BLEND}, g AS (SELECT case_id, mask_id, min(z) / {D}.0 AS z1, (max(z) + 1) / {D}.0 AS z2, avg(z) / {D}.0 AS cz, min(y) / {H}.0 AS y1, (max(y) + 1) / {H}.0 AS y2, avg(y) / {H}.0 AS cy,
          min(x) / {W}.0 AS x1, (max(x) + 1) / {W}.0 AS x2, avg(x) / {W}.0 AS cx FROM gt GROUP BY case_id, mask_id),
        j AS (SELECT b.*, g.z1, g.z2, g.y1, g.y2, g.x1, g.x2, g.cz, g.cy, g.cx, greatest(0, least(b.z_max, g.z2) - greatest(b.z_min, g.z1)) AS iz, greatest(0, least(b.y_max, g.y2) - greatest(b.y_min, g.y1)) AS iy,
          greatest(0, least(b.x_max, g.x2) - greatest(b.x_min, g.x1)) AS ix, greatest(0, z_max - z_min) * greatest(0, y_max - y_min) * greatest(0, x_max - x_min) AS vp, (g.z2 - g.z1) * (g.y2 - g.y1) * (g.x2 - g.x1) AS vg FROM blend b JOIN g ON b.case_id = g.case_id AND b.mask_id = g.mask_id)
        SELECT target_form, count(*) AS n, round(avg(CASE WHEN anatomy <> 'unknown' THEN 1.0::double ELSE 0 END), 6) AS parse_coverage,
          round(avg(CASE WHEN cz BETWEEN z_min AND z_max AND cy BETWEEN y_min AND y_max AND cx BETWEEN x_min AND x_max THEN 1.0::double ELSE 0 END), 6) AS centroid_inside,
          round(avg(iz / (z2 - z1)), 6) AS z_recall, round(avg(iz * iy * ix / (vp + vg - iz * iy * ix)), 6) AS box_iou, round(avg(vp / vg), 6) AS volume_ratio FROM j GROUP BY target_form""",
)
def _(d):
    from ..operators.quality import prompt_quality

    return rounded(prompt_quality(blended(d), bx.box3d_half_open(d.gt, D, H, W), ["target_form"]))
