"""Phase 7: tuple sampling, n-way scores and ranking losses.

Passages: all ``embeddings`` rows (pid = vec_id, label).  The searched variant
uses each passage's own top-10 matches (self removed).  The oracle SQL runs
the same md5 draws, Floyd steps (``list_reduce``) and Efraimidis-Spirakis keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinity.functions.hashing import uniform_sql
from vicinity.operators import metrics, sampling
from vicinity.operators.similarity import knn_join, maxsim_pairs
from vicinity.operators.encode import group_mean
from vicinity.plans import fixtures as fx
from vicinity.plans import register, with_ctes
from vicinity.functions.vectors import dot

# fixed query parameters
SEED = 42
NWAY = 4
K = 10
N_POS = 1
N_NEG = NWAY - 2


def U(*exprs: str) -> str:
    return uniform_sql(SEED, *exprs)


def floyd_sql(tag: str, keys: list[str], size: str, m: str) -> str:
    pick = f"CAST(floor({U(*keys, repr(tag), 'j')} * (j + 1)) AS BIGINT)"
    return (f"list_reduce(range(CAST(({size}) - ({m}) AS BIGINT), CAST({size} AS BIGINT)), lambda acc, j: CASE WHEN list_contains(acc, {pick}) "
            f"THEN list_append(acc, j) ELSE list_append(acc, {pick}) END, []::BIGINT[])")


def pools_sql(src: str) -> str:
    """CTEs pos(pid, label, gpos), pool(label, cnt, start), ntot(n), anc(anchor, label, cnt, start, lpos, n)."""
    return f"""
pp AS (SELECT pid, label FROM {src}),
pos AS (SELECT pid, label, row_number() OVER (ORDER BY label, {U("'b'", 'pid')}, pid) - 1 AS gpos FROM pp),
pool AS (SELECT label, count(*) AS cnt, min(gpos) AS start FROM pos GROUP BY label),
ntot AS (SELECT count(*) AS n FROM pp),
anc AS (SELECT pos.pid AS anchor, pos.label, pool.cnt, pool.start, pos.gpos - pool.start AS lpos, ntot.n
        FROM pos JOIN pool USING (label) CROSS JOIN ntot)"""


def random_tuples_sql(nway: int) -> str:
    return f"""
pd AS (SELECT anchor, 1 AS slot,
              CASE WHEN cnt > 1 THEN start + o + CASE WHEN o >= lpos THEN 1 ELSE 0 END ELSE start + lpos END AS gpos
       FROM (SELECT *, CAST(floor({U('anchor', "'pos'")} * (cnt - 1)) AS BIGINT) AS o FROM anc)),
nsel AS (SELECT anchor, start, cnt, {floyd_sql('neg', ['anchor'], 'n - cnt', f'least({nway - 2}, n - cnt)')} AS sel FROM anc),
nd AS (SELECT anchor, CAST(k + 2 AS INTEGER) AS slot, CASE WHEN o < start THEN o ELSE o + cnt END AS gpos
       FROM (SELECT anchor, start, cnt, unnest(sel) AS o, unnest(range(len(sel))) AS k FROM nsel)),
tup AS (SELECT anchor, CAST(0 AS INTEGER) AS slot, anchor AS pid FROM anc
        UNION ALL
        SELECT d.anchor, CAST(d.slot AS INTEGER) AS slot, pos.pid
        FROM (SELECT anchor, slot, gpos FROM pd UNION ALL SELECT anchor, slot, gpos FROM nd) d JOIN pos USING (gpos))"""


_EMB = "emb AS (SELECT vec_id AS pid, label, embedding::DOUBLE[] AS vec FROM embeddings)"


def _passages(spark, sf):
    return fx.vectors(spark, sf).select("pid", "label", "vec")


# --------------------------------------------------------------------------- N1 / N2 / N4

@register("label_pools", with_ctes(_EMB, pools_sql("emb")) + "SELECT label, cnt, start FROM pool")
def label_pools(spark, sf):
    """Contiguous position range of every label."""
    _, pools = sampling.label_pools(_passages(spark, sf).select("pid", "label"), SEED)
    return pools


@register("sample_random", with_ctes(_EMB, pools_sql("emb"), random_tuples_sql(NWAY)) + "SELECT anchor, slot, pid FROM tup")
def sample_random(spark, sf):
    """Uniform positive + distinct uniform negatives per anchor, never materialising pools."""
    return sampling.random_tuples(_passages(spark, sf).select("pid", "label"), NWAY, SEED)


def _classwise_nway(n_labels: int) -> int:
    return 2 + (n_labels - 1)


@register("sample_classwise", with_ctes(_EMB, pools_sql("emb"), f"""
pd AS (SELECT anchor, 1 AS slot,
              CASE WHEN cnt > 1 THEN start + o + CASE WHEN o >= lpos THEN 1 ELSE 0 END ELSE start + lpos END AS gpos
       FROM (SELECT *, CAST(floor({U('anchor', "'pos'")} * (cnt - 1)) AS BIGINT) AS o FROM anc)),
oth AS (SELECT a.anchor, p.label, p.cnt, p.start,
               row_number() OVER (PARTITION BY a.anchor ORDER BY p.label) - 1 AS ci FROM anc a JOIN pool p ON p.label <> a.label),
csel AS (SELECT anchor, ci, start, {floyd_sql('cw', ['anchor', 'label'], 'cnt', 'least(1, cnt)')} AS sel FROM oth),
cd AS (SELECT anchor, ci + k + 2 AS slot, start + o AS gpos
       FROM (SELECT anchor, ci, start, unnest(sel) AS o, unnest(range(len(sel))) AS k FROM csel)),
tup AS (SELECT anchor, CAST(0 AS INTEGER) AS slot, anchor AS pid FROM anc
        UNION ALL
        SELECT d.anchor, CAST(d.slot AS INTEGER) AS slot, pos.pid
        FROM (SELECT anchor, slot, gpos FROM pd UNION ALL SELECT anchor, slot, gpos FROM cd) d JOIN pos USING (gpos))""")
          + "SELECT anchor, slot, pid FROM tup")
def sample_classwise(spark, sf):
    """One negative from every other class (nway = 2 + (L-1)) (N4, D3 fixed)."""
    p = _passages(spark, sf).select("pid", "label")
    n_labels = p.select("label").distinct().count()
    return sampling.classwise_tuples(p, _classwise_nway(n_labels), SEED)


# --------------------------------------------------------------------------- N5 / N7 / N9 / N10 / N11

_ALL = "a AS (SELECT vec_id AS qid, vec_id AS pid, embedding::DOUBLE[] AS vec FROM embeddings)"

def searched_sql(always_random_pos: bool = False) -> str:
    """CTEs up to ``cand(anchor, role, pid, score, ord)`` for searched sampling."""
    keep = "WHERE role = 'neg'" if always_random_pos else ""
    npos = 1 if always_random_pos else N_POS
    return with_ctes(_EMB, pools_sql("emb"), _ALL, fx.knn_sql(K, src_q="a", src_c="a"), f"""
sm AS (SELECT m.qid AS anchor, m.rank, m.pid, m.score, CASE WHEN pa.label = pb.label THEN 'pos' ELSE 'neg' END AS role
       FROM m JOIN pp pa ON pa.pid = m.qid JOIN pp pb ON pb.pid = m.pid WHERE m.pid <> m.qid),
sm0 AS (SELECT * FROM sm {keep}),
ret AS (SELECT anchor, role, pid, score, CAST(rank AS BIGINT) AS ord FROM sm0),
st AS (SELECT anchor, max(rank) AS lastrank, CAST(sum(CASE WHEN role = 'pos' THEN 1 ELSE 0 END) AS BIGINT) AS npos,
              CAST(sum(CASE WHEN role = 'neg' THEN 1 ELSE 0 END) AS BIGINT) AS nneg,
              min(CASE WHEN role = 'pos' THEN score END) AS minpos,
              min(CASE WHEN role = 'neg' THEN score END) AS minneg FROM sm0 GROUP BY anchor),
aa AS (SELECT anc.*, coalesce(st.npos, 0) AS npos, coalesce(st.nneg, 0) AS nneg, coalesce(st.lastrank, 0) AS lastrank, st.minpos, st.minneg,
              greatest(least({npos}, anc.cnt - 1) - coalesce(st.npos, 0), 0) AS dpos,
              greatest(least({N_NEG}, anc.n - anc.cnt) - coalesce(st.nneg, 0), 0) AS dneg
       FROM anc LEFT JOIN st USING (anchor)),
fp AS (SELECT anchor, start + o + CASE WHEN o >= lpos THEN 1 ELSE 0 END AS gpos,
              coalesce(minpos, 1.0::DOUBLE) AS score, 'pos' AS role, dpos AS need, lastrank
       FROM (SELECT *, unnest({floyd_sql('fp', ['anchor'], 'cnt - 1', 'least(cnt - 1, dpos + npos)')}) AS o
             FROM aa WHERE dpos > 0)),
fn AS (SELECT anchor, CASE WHEN o < start THEN o ELSE o + cnt END AS gpos,
              coalesce(minneg, 1.0::DOUBLE) AS score, 'neg' AS role, dneg AS need, lastrank
       FROM (SELECT *, unnest({floyd_sql('fn', ['anchor'], 'n - cnt', 'least(n - cnt, dneg + nneg)')}) AS o
             FROM aa WHERE dneg > 0)),
fills AS (SELECT f.anchor, f.role, pos.pid, f.score, f.need, f.lastrank
          FROM (SELECT * FROM fp UNION ALL SELECT * FROM fn) f JOIN pos USING (gpos)
          WHERE NOT EXISTS (SELECT 1 FROM ret WHERE ret.anchor = f.anchor AND ret.pid = pos.pid)),
fsel AS (SELECT anchor, role, pid, score, CAST(lastrank + fi AS BIGINT) AS ord FROM (
           SELECT *, row_number() OVER (PARTITION BY anchor, role ORDER BY {U('anchor', 'pid', "'f'")}, pid) AS fi
           FROM fills) WHERE fi <= need),
cand AS (SELECT * FROM ret UNION ALL SELECT * FROM fsel)""")


_SEARCHED = searched_sql()


def _weights_sql(kind: str, lower_ranked_positives: bool = False) -> str:
    if kind == "scores":
        x = "score"
    else:
        rn = "row_number() OVER (PARTITION BY anchor, role ORDER BY ord)"
        x = f"CAST(count(*) OVER (PARTITION BY anchor, role) - ({rn} - 1) AS DOUBLE)"
        if lower_ranked_positives:
            x = f"CASE WHEN role = 'pos' THEN CAST({rn} AS DOUBLE) ELSE {x} END"
    return f"""
cx AS (SELECT *, {x} AS x FROM cand),
wt AS (SELECT anchor, role, pid, score, ord,
              CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w)
                   ELSE 1.0::DOUBLE END AS weight
       FROM cx WINDOW w AS (PARTITION BY anchor, role))"""


def _searched(spark, sf):
    p = _passages(spark, sf)
    m = knn_join(p.select(F.col("pid").alias("qid"), "vec"), p.select("pid", "vec"), K)
    return p, sampling.searched_candidates(m, p.select("pid", "label"), N_POS, N_NEG, SEED)


@register("sample_searched", _SEARCHED + "SELECT anchor, role, pid, round(score, 6) AS score, ord FROM cand")
def sample_searched(spark, sf):
    """Own matches split by label, self removed, deficits filled with random
    non-retrieved passages at the minimum retrieved score (N5, N7)."""
    _, c = _searched(spark, sf)
    return c.select("anchor", "role", "pid", F.round("score", 6).alias("score"), "ord")


@register("sampling_weights", _SEARCHED.rstrip() + "," + _weights_sql("scores")
          + "SELECT anchor, role, pid, round(weight, 9) AS weight FROM wt")
def sampling_weights(spark, sf):
    """Min-max normalised score weights per anchor and role."""
    _, c = _searched(spark, sf)
    w = sampling.candidate_weights(c, "scores")
    return w.select("anchor", "role", "pid", F.round("weight", 9).alias("weight"))


@register("sampling_weights_ranks", _SEARCHED.rstrip() + "," + _weights_sql("ranks")
          + "SELECT anchor, role, pid, round(weight, 9) AS weight FROM wt")
def sampling_weights_ranks(spark, sf):
    """Rank weights n..1 in candidate order, min-max normalised."""
    _, c = _searched(spark, sf)
    w = sampling.candidate_weights(c, "ranks")
    return w.select("anchor", "role", "pid", F.round("weight", 9).alias("weight"))


@register("sampling_missing", _SEARCHED + """
SELECT round(avg(coalesce(mp, 0)), 9) AS missing_pos, round(avg(coalesce(mn, 0)), 9) AS missing_neg
FROM anc LEFT JOIN (SELECT anchor, sum(CASE WHEN role = 'pos' THEN 1 ELSE 0 END) AS mp,
                           sum(CASE WHEN role = 'neg' THEN 1 ELSE 0 END) AS mn FROM fsel GROUP BY anchor) USING (anchor)""")
def sampling_missing(spark, sf):
    """Average missing (filled-up) positives and negatives per anchor."""
    p, c = _searched(spark, sf)
    return sampling.missing_report(c, p.select(F.col("pid").alias("anchor")))


_DRAW_SQL = f"""
dk AS (SELECT *, {U('anchor', 'pid', 'role')} AS u FROM wt),
dk2 AS (SELECT *, CASE WHEN weight > 0 THEN ln(u) / weight END AS key FROM dk),
rk AS (SELECT *, row_number() OVER (PARTITION BY anchor, role ORDER BY weight > 0 DESC, key DESC NULLS LAST,
                                    u DESC, pid) AS r FROM dk2),
tup AS (SELECT DISTINCT anchor, CAST(0 AS INTEGER) AS slot, anchor AS pid FROM wt
        UNION ALL SELECT anchor, CAST(1 AS INTEGER), pid FROM rk WHERE role = 'pos' AND r = 1
        UNION ALL SELECT DISTINCT anchor, CAST(1 AS INTEGER), anchor FROM wt
                  WHERE anchor NOT IN (SELECT anchor FROM wt WHERE role = 'pos')
        UNION ALL SELECT anchor, CAST(r + 1 AS INTEGER), pid FROM rk WHERE role = 'neg' AND r <= {NWAY - 2})"""


@register("nway_tuples", _SEARCHED.rstrip() + "," + _weights_sql("scores") + "," + _DRAW_SQL
          + "SELECT anchor, slot, pid FROM tup")
def nway_tuples(spark, sf):
    """Weighted draw without replacement: 1 positive, nway-2 negatives (N11; D9, D10)."""
    _, c = _searched(spark, sf)
    return sampling.draw_tuples(sampling.candidate_weights(c, "scores"), NWAY, SEED)


@register("sample_searched_ml", with_ctes(fx.ML_CTES, _ALL, fx.knn_sql(K, src_q="a", src_c="a")) + """
SELECT m.qid AS anchor, m.rank, m.pid, m.score,
       CASE WHEN list_has_any(pa.labels, pb.labels) THEN 'pos' ELSE 'neg' END AS role
FROM m JOIN ml pa ON pa.pid = m.qid JOIN ml pb ON pb.pid = m.pid WHERE m.pid <> m.qid""")
def sample_searched_ml(spark, sf):
    """Multi-label split of own matches: positives share a label, negatives none."""
    ml = fx.multilabel_vectors(spark, sf)
    m = knn_join(ml.select(F.col("pid").alias("qid"), "vec"), ml.select("pid", "vec"), K)
    return sampling.searched_candidates_ml(m, ml.select("pid", "labels"))


# --------------------------------------------------------------------------- N12 on documents

_DLP = with_ctes(fx.DL_CTES, "dlp AS (SELECT pid, label, text FROM dl)", pools_sql("dlp"), random_tuples_sql(3))


@register("nway_text", _DLP + """
SELECT t.anchor, list(d.text ORDER BY t.slot) AS texts, 0 AS target
FROM tup t JOIN dlp d ON d.pid = t.pid GROUP BY t.anchor""")
def nway_text(spark, sf):
    """Triples over labelled documents materialised as texts in slot order, target 0."""
    dl = fx.labelled_docs(spark, sf).select("pid", "label", "text")
    t = sampling.random_tuples(dl.select("pid", "label"), 3, SEED)
    return sampling.materialise_tuples(t, dl)


# --------------------------------------------------------------------------- J9 / M16 / M17 on MV

_MVT = with_ctes(fx.MV_CTES, "mvp AS (SELECT pid, label FROM mvl)", pools_sql("mvp"), random_tuples_sql(NWAY), f"""
pool_mean AS (SELECT pid, [{', '.join(f'avg(vec[{i + 1}])' for i in range(64))}] AS pv FROM mv GROUP BY pid),
sc AS (SELECT t.anchor, t.slot, t.pid, sum(mx) AS score FROM (
         SELECT t.anchor, t.slot, t.pid, qa.pos, max(list_inner_product(qa.vec, qb.vec)) AS mx
         FROM tup t JOIN mv qa ON qa.pid = t.anchor JOIN mv qb ON qb.pid = t.pid
         WHERE t.slot > 0 GROUP BY t.anchor, t.slot, t.pid, qa.pos) t GROUP BY t.anchor, t.slot, t.pid),
ns AS (SELECT sc.anchor, sc.slot, sc.score, list_inner_product(pa.pv, pb.pv) AS teacher
       FROM sc JOIN pool_mean pa ON pa.pid = sc.anchor JOIN pool_mean pb ON pb.pid = sc.pid)""")


def _nway_scores(spark, sf):
    mv = fx.multi_vectors(spark, sf).select("pid", "pos", F.col("vec").cast("array<double>").alias("vec"), "label")
    lab = mv.filter(F.col("pos") == 0).select("pid", "label")
    t = sampling.random_tuples(lab, NWAY, SEED).filter(F.col("slot") > 0)
    pairs = t.select(F.col("anchor").alias("qid"), "pid")
    qv = mv.select(F.col("pid").alias("qid"), F.col("pos").alias("qpos"), "vec")
    student = maxsim_pairs(qv, mv.select("pid", "pos", "vec"), pairs)
    pooled = group_mean(mv, ["pid"], normalize=False)   # sbert path: not normalised
    teacher = (pairs.join(pooled.select(F.col("pid").alias("qid"), F.col("vec").alias("qv")), "qid")
               .join(pooled.select("pid", F.col("vec").alias("pv")), "pid")
               .select("qid", "pid", dot("qv", "pv").alias("teacher")))
    s = (t.join(student.withColumnRenamed("qid", "anchor"), ["anchor", "pid"])
         .join(teacher.withColumnRenamed("qid", "anchor"), ["anchor", "pid"]))
    return s.select("anchor", "slot", "score", "teacher")


@register("nway_scores", _MVT + "SELECT anchor, slot, round(score, 6) AS score, round(teacher, 6) AS teacher FROM ns")
def nway_scores(spark, sf):
    """Anchor scored against every other tuple slot: MaxSim (student) and pooled dot (teacher)."""
    s = _nway_scores(spark, sf)
    return s.select("anchor", "slot", F.round("score", 6).alias("score"), F.round("teacher", 6).alias("teacher"))


@register("contrastive_loss", _MVT + """
SELECT round(avg(lse - s0), 9) AS loss FROM (
  SELECT anchor, mx + ln(sum(exp(score - mx))) AS lse, max(CASE WHEN slot = 1 THEN score END) AS s0
  FROM (SELECT anchor, slot, score, max(score) OVER (PARTITION BY anchor) AS mx FROM ns) GROUP BY anchor, mx)""")
def contrastive_loss(spark, sf):
    """Mean of logsumexp(scores) - score of the positive (target slot 0 among non-anchor slots)."""
    s = _nway_scores(spark, sf).select("anchor", (F.col("slot") - 1).alias("slot"), "score")
    return metrics.contrastive_loss(s)


@register("distill_kl", _MVT + """
SELECT round(sum(exp(lt) * (lt - ls)) / count(DISTINCT anchor), 9) AS kl FROM (
  SELECT anchor, teacher - (tm + ln(sum(exp(teacher - tm)) OVER w)) AS lt,
                 score - (sm + ln(sum(exp(score - sm)) OVER w)) AS ls
  FROM (SELECT *, max(teacher) OVER w AS tm, max(score) OVER w AS sm FROM ns WINDOW w AS (PARTITION BY anchor))
  WINDOW w AS (PARTITION BY anchor))""")
def distill_kl(spark, sf):
    """Distillation KL: sum exp(t)(t - s) / B, t = log-softmax(alpha * teacher), s = log-softmax(score),
    alpha = 1 (M17; D20: explicit argument)."""
    return metrics.distillation_kl(_nway_scores(spark, sf), alpha=1.0)


# --------------------------------------------------------------------------- N8 / N9 options

@register("sample_searched_random_pos", searched_sql(True).rstrip() + "," + _weights_sql("scores") + ","
          + _DRAW_SQL + "SELECT anchor, slot, pid FROM tup")
def sample_searched_random_pos(spark, sf):
    """Searched negatives with ``positive_always_random``: the positive is a uniform draw
    from the whole label pool (weight 1), not a retrieved match (N8; D8)."""
    p = _passages(spark, sf)
    m = knn_join(p.select(F.col("pid").alias("qid"), "vec"), p.select("pid", "vec"), K)
    c = sampling.searched_candidates(m, p.select("pid", "label"), N_POS, N_NEG, SEED, positive_always_random=True)
    w = sampling.candidate_weights(c, "scores", uniform_positives=True)
    return sampling.draw_tuples(w, NWAY, SEED)


@register("sampling_weights_lower", _SEARCHED.rstrip() + "," + _weights_sql("ranks", lower_ranked_positives=True)
          + "SELECT anchor, role, pid, round(weight, 9) AS weight FROM wt")
def sampling_weights_lower(spark, sf):
    """Rank weights with ``lower_ranked_positives``: positives weighted 1..n."""
    _, c = _searched(spark, sf)
    w = sampling.candidate_weights(c, "ranks", lower_ranked_positives=True)
    return w.select("anchor", "role", "pid", F.round("weight", 9).alias("weight"))


def random_ml_sql(n_pos: int, n_neg: int) -> str:
    """SQL twin of :func:`vicinity.operators.sampling.random_candidates_ml`: ``dr(anchor, role, i, pid)``.

    The same order of passages (label ranks by frequency, then hash) and the same Floyd draws; the ranks among related
    and unrelated passages are counted pair by pair."""
    def draw(role, n):
        m = f"least({n}, n{role})"
        return f"""SELECT anchor, '{role}' AS role, unnest(sel) AS r, unnest(range(len(sel))) AS i
                   FROM (SELECT *, {floyd_sql(role, ['anchor'], f'n{role}', m)} AS sel FROM sizes)"""
    return with_ctes(fx.ML_CTES, f"""
lab AS (SELECT pid, list_distinct(labels) AS labels FROM ml),
ex AS (SELECT pid, unnest(labels) AS label FROM lab),
lrk AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS lr FROM ex GROUP BY label),
sg AS (SELECT lab.pid, lab.labels, coalesce(k.sig, []) AS sig FROM lab
       LEFT JOIN (SELECT pid, list_sort(list(lr)) AS sig FROM ex JOIN lrk USING (label) GROUP BY pid) k USING (pid)),
gp AS (SELECT pid, labels, row_number() OVER (ORDER BY sig, {U("'b'", 'pid')}, pid) AS gpos FROM sg),
ov AS (SELECT a.pid AS anchor, b.pid, b.gpos, CASE WHEN list_has_any(a.labels, b.labels) THEN 'pos' ELSE 'neg' END AS role
       FROM gp a JOIN gp b ON a.pid <> b.pid),
rel AS (SELECT anchor, role, pid, row_number() OVER (PARTITION BY anchor, role ORDER BY gpos) - 1 AS r FROM ov),
sizes AS (SELECT lab.pid AS anchor, count(rel.pid) FILTER (role = 'pos') AS npos, count(rel.pid) FILTER (role = 'neg') AS nneg
          FROM lab LEFT JOIN rel ON rel.anchor = lab.pid GROUP BY lab.pid),
dd AS ({draw('pos', n_pos)} UNION ALL {draw('neg', n_neg)}),
dr AS (SELECT dd.anchor, dd.role, dd.i, rel.pid FROM dd JOIN rel ON rel.anchor = dd.anchor AND rel.role = dd.role AND rel.r = dd.r)""")


@register("sample_random_ml", random_ml_sql(1, NWAY - 2) + """
SELECT pid AS anchor, CAST(0 AS INTEGER) AS slot, pid FROM lab
UNION ALL SELECT lab.pid, CAST(1 AS INTEGER), coalesce(dr.pid, lab.pid) FROM lab LEFT JOIN dr ON dr.anchor = lab.pid AND dr.role = 'pos'
UNION ALL SELECT anchor, CAST(i + 2 AS INTEGER), pid FROM dr WHERE role = 'neg'""")
def sample_random_ml(spark, sf):
    """Multi-label random tuples drawn by rank (N3): positives share a label, negatives share none, uniform and without
    replacement."""
    ml = fx.multilabel_vectors(spark, sf).select("pid", "labels")
    return sampling.random_tuples_ml(ml, NWAY, SEED)


@register("sample_candidates_ml", random_ml_sql(5, 40) + "SELECT anchor, role, i, pid FROM dr")
def sample_candidates_ml(spark, sf):
    """Five random positives and forty negatives of every multi-label passage, or all there are."""
    return sampling.random_candidates_ml(fx.multilabel_vectors(spark, sf).select("pid", "labels"), 5, 40, SEED)


_ML_FILL = random_ml_sql(N_POS + K, N_NEG + K).rstrip() + "," + _ALL.strip() + "," + fx.knn_sql(K, src_q="a", src_c="a") + f""",
sm AS (SELECT m.qid AS anchor, m.rank, m.pid, m.score,
              CASE WHEN list_has_any(pa.labels, pb.labels) THEN 'pos' ELSE 'neg' END AS role
       FROM m JOIN ml pa ON pa.pid = m.qid JOIN ml pb ON pb.pid = m.pid WHERE m.pid <> m.qid),
st AS (SELECT anchor, max(rank) AS lastrank, count(*) FILTER (role = 'pos') AS npos, count(*) FILTER (role = 'neg') AS nneg,
              min(score) FILTER (role = 'pos') AS minpos, min(score) FILTER (role = 'neg') AS minneg FROM sm GROUP BY anchor),
fresh AS (SELECT t.anchor, t.role, t.pid, t.i, coalesce(st.lastrank, 0) AS lastrank,
                 coalesce(st.npos, 0) AS npos, coalesce(st.nneg, 0) AS nneg, st.minpos, st.minneg
          FROM dr t LEFT JOIN st USING (anchor)
          WHERE NOT EXISTS (SELECT 1 FROM sm WHERE sm.anchor = t.anchor AND sm.pid = t.pid)),
fsel AS (SELECT anchor, role, pid, coalesce(CASE WHEN role = 'pos' THEN minpos ELSE minneg END, 1.0::DOUBLE) AS score,
                CAST(lastrank + fi AS BIGINT) AS ord
         FROM (SELECT *, row_number() OVER (PARTITION BY anchor, role ORDER BY i) AS fi FROM fresh)
         WHERE fi <= CASE WHEN role = 'pos' THEN {N_POS} - npos ELSE {N_NEG} - nneg END),
cand AS (SELECT anchor, role, pid, score, CAST(rank AS BIGINT) AS ord FROM sm UNION ALL SELECT * FROM fsel)"""


def _filled_ml(spark, sf):
    ml = fx.multilabel_vectors(spark, sf)
    m = knn_join(ml.select(F.col("pid").alias("qid"), "vec"), ml.select("pid", "vec"), K)
    return sampling.searched_filled_ml(m, ml.select("pid", "labels"), K, N_POS, N_NEG, SEED)


@register("sample_filled_ml", _ML_FILL + "SELECT anchor, role, pid, round(score, 6) AS score, ord FROM cand")
def sample_filled_ml(spark, sf):
    """Multi-label searched candidates, deficits filled at the lowest retrieved score."""
    return _filled_ml(spark, sf).select("anchor", "role", "pid", F.round("score", 6).alias("score"), "ord")


@register("nway_tuples_ml", _ML_FILL + "," + _weights_sql("scores") + "," + _DRAW_SQL + "SELECT anchor, slot, pid FROM tup")
def nway_tuples_ml(spark, sf):
    """Weighted n-way tuples from the filled multi-label candidates."""
    return sampling.draw_tuples(sampling.candidate_weights(_filled_ml(spark, sf), "scores"), NWAY, SEED)
