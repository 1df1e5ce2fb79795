"""SQL counterparts of the registered queries, for DuckDB on the same tables.

They state definitions (global row numbers, question x tag products, chained iterations), not
the physical forms the Spark side uses.
"""

from __future__ import annotations

import math

from tagloom.functions import porter
from tagloom.functions.stopwords import DEFAULT

_STOP = ", ".join(f"'{w}'" for w in DEFAULT)

_Q = """
q AS (
  SELECT d.doc_id AS q_id,
         split_part(d.text, chr(10), 1) AS title,
         substring(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS body,
         list_filter([d.lang, d.source,
           CASE WHEN l.quality = 1 THEN 'quality' END,
           CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS tags,
         d.source AS src_file, d.doc_id AS pos
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_QT = "qt AS (SELECT DISTINCT q_id, lower(t) AS tag FROM (SELECT q_id, unnest(tags) AS t FROM q))"
_TAGS = """
tag_counts AS (SELECT tag, count(*) AS cnt FROM qt GROUP BY tag),
tags AS (SELECT tag, cnt FROM tag_counts WHERE cnt * 20 > (SELECT count(*) FROM q))"""
_CONTENT = "qc AS (SELECT *, concat_ws(' ', title, body) AS content FROM q)"
_SPLIT = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY src_file ORDER BY pos) AS rn,
                    count(*) OVER (PARTITION BY src_file) AS n FROM qc),
split AS (SELECT *, CASE WHEN rn <= n - floor(n * 0.1) THEN 'train' ELSE 'holdout' END AS split
          FROM numbered),
indexed AS (SELECT * FROM split WHERE split = 'train'),
heldout AS (SELECT * FROM split WHERE split = 'holdout')"""
_PAIRS = """
pos AS (SELECT tags.tag, qt.q_id FROM tags JOIN qt ON tags.tag = qt.tag
        JOIN indexed ON indexed.q_id = qt.q_id),
k AS (SELECT tag, count(*) AS k FROM pos GROUP BY tag),
neg AS (SELECT tag, q_id FROM (
          SELECT k.tag, i.q_id, k.k, row_number() OVER (PARTITION BY k.tag ORDER BY i.q_id) AS r
          FROM k CROSS JOIN indexed i
          WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.tag = k.tag AND p.q_id = i.q_id))
        WHERE r <= k),
pairs AS MATERIALIZED (SELECT tag, 1 AS label, q_id FROM pos UNION ALL SELECT tag, 0, q_id FROM neg)"""

CORPUS = ["WITH" + _Q, _QT, _TAGS, _CONTENT, _SPLIT, _PAIRS]

_PLAIN = f"""
plain AS MATERIALIZED (
  SELECT q_id, term, count(*) AS tf FROM (
    SELECT q_id, lower(unnest(regexp_extract_all(content, '\\p{{L}}{{1,255}}'))) AS term FROM qc)
  WHERE length(term) BETWEEN 3 AND 100 AND term NOT IN ({_STOP}) GROUP BY q_id, term)"""

_PER_TAG = """
sizes AS (SELECT tag, count(*) AS n FROM pairs GROUP BY tag),
dfs AS (SELECT p.tag, t.term, count(DISTINCT p.q_id) AS df
        FROM pairs p JOIN plain t ON p.q_id = t.q_id GROUP BY p.tag, t.term),
idf AS MATERIALIZED (SELECT d.tag, d.term, d.df, s.n::DOUBLE / d.df::DOUBLE AS idf
        FROM dfs d JOIN sizes s ON d.tag = s.tag WHERE d.df > 3),
feat AS MATERIALIZED (
  SELECT p.tag, p.label, p.q_id, t.term,
         t.tf::DOUBLE / (sum(t.tf) OVER (PARTITION BY p.tag, p.q_id))::DOUBLE * i.idf AS x
  FROM pairs p JOIN plain t ON p.q_id = t.q_id JOIN idf i ON i.tag = p.tag AND i.term = t.term)"""


def _with(*parts: str) -> str:
    return ",\n".join([*CORPUS, *parts]) + "\n"


def _svm(rounds: int = 20, rows: str = "feat", members: str = "pairs") -> str:
    """The rounds as chained queries: w0 .. w20."""
    parts = [
        f"members AS MATERIALIZED (SELECT * FROM {members})",
        "msize AS (SELECT tag, count(*) AS n FROM members GROUP BY tag)",
        f"rows AS MATERIALIZED (SELECT *, 2.0::DOUBLE * label - 1 AS s FROM {rows})",
        "w0 AS MATERIALIZED (SELECT tag, term, 0.0::DOUBLE AS w FROM idf)",
    ]
    for i in range(1, rounds + 1):
        eta = 1.0 / math.sqrt(i)
        parts += [
            f"""m{i} AS (SELECT r.tag, r.q_id, any_value(r.s) AS s, sum(r.x * w.w) AS m
              FROM rows r JOIN w{i - 1} w ON w.tag = r.tag AND w.term = r.term
              GROUP BY r.tag, r.q_id)""",
            f"""g{i} AS (SELECT r.tag, r.term, sum(r.s * r.x) / any_value(z.n) AS g
              FROM rows r JOIN m{i} m ON m.tag = r.tag AND m.q_id = r.q_id
              JOIN msize z ON z.tag = r.tag WHERE m.s * m.m < 1 GROUP BY r.tag, r.term)""",
            f"""w{i} AS MATERIALIZED (SELECT w.tag, w.term,
              w.w * {1.0 - eta * 0.01!r}::DOUBLE + {eta!r}::DOUBLE * coalesce(g.g, 0) AS w
              FROM w{i - 1} w LEFT JOIN g{i} g ON g.tag = w.tag AND g.term = w.term)""",
        ]
    return ",\n".join(parts)


def _stem_ctes(source: str) -> str:
    """The published suffix rules as one SELECT per step over ``source(term)``."""

    def cut(n):
        return f"substring(w, 1, length(w) - {n})"

    def has(x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    def table(rules, condition):
        ends = sorted(rules, key=len, reverse=True)
        cases = " ".join(
            f"WHEN ends_with(w, '{e}') THEN CASE WHEN {has(cut(len(e)), condition)} "
            f"THEN {cut(len(e))} || '{rules[e]}' ELSE w END" for e in ends
        )
        return f"CASE {cases} ELSE w END"

    def lost(n):
        return f"CASE WHEN {has(cut(n), porter.HAS_VOWEL)} THEN {cut(n)} || '#' ELSE w END"

    step_4 = {e: "" for e in porter.STEP_4} | {"sion": "s", "tion": "t"}
    drop = " ".join(
        f"WHEN ends_with(w, '{e}') THEN CASE WHEN {has(cut(len(e)) + f" || '{step_4[e]}'", porter.M_GT_1)} "
        f"THEN {cut(len(e))} || '{step_4[e]}' ELSE w END"
        for e in sorted(step_4, key=len, reverse=True)
    )
    steps = [
        "CASE WHEN starts_with(w, 'y') THEN 'Y' || substring(w, 2) ELSE w END",
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} "
        f"WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {has(cut(3), porter.M_GT_0)} THEN {cut(1)} ELSE w END "
        f"WHEN ends_with(w, 'ed') THEN {lost(2)} WHEN ends_with(w, 'ing') THEN {lost(3)} ELSE w END",
        f"CASE WHEN NOT ends_with(w, '#') THEN w "
        f"WHEN ends_with(w, 'at#') OR ends_with(w, 'bl#') OR ends_with(w, 'iz#') THEN {cut(1)} || 'e' "
        f"WHEN length(w) >= 3 AND substring(w, length(w) - 1, 1) = substring(w, length(w) - 2, 1) "
        f"AND NOT {has('substring(w, length(w) - 1, 1)', '[aeiouylsz]')} THEN {cut(2)} "
        f"WHEN {has(cut(1), porter.M_EQ_1)} AND {has(cut(1), porter.CVC)} THEN {cut(1)} || 'e' "
        f"ELSE {cut(1)} END",
        f"CASE WHEN ends_with(w, 'y') AND {has(cut(1), porter.HAS_VOWEL)} THEN {cut(1)} || 'i' ELSE w END",
        table(porter.STEP_2, porter.M_GT_0),
        table(porter.STEP_3, porter.M_GT_0),
        f"CASE {drop} ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND ({has(cut(1), porter.M_GT_1)} OR "
        f"({has(cut(1), porter.M_EQ_1)} AND NOT {has(cut(1), porter.CVC)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {has('w', porter.M_GT_1)} THEN {cut(1)} ELSE w END",
        "CASE WHEN starts_with(w, 'Y') THEN 'y' || substring(w, 2) ELSE w END",
    ]
    parts = [f"s0 AS (SELECT DISTINCT term, term AS w FROM {source})"]
    for i, step in enumerate(steps, 1):
        parts.append(f"s{i} AS (SELECT term, {step} AS w FROM s{i - 1})")
    parts.append(
        f"stems AS MATERIALIZED (SELECT term, CASE WHEN length(term) > 2 THEN w ELSE term END AS stem "
        f"FROM s{len(steps)})"
    )
    return ",\n".join(parts)


_WORDS = "words AS MATERIALIZED (SELECT q_id, lower(unnest(regexp_extract_all(content, '\\p{L}{1,255}'))) AS term FROM qc)"
_STEMMED = f"""{_WORDS},
{_stem_ctes("words")},
stemmed AS MATERIALIZED (SELECT w.q_id, s.stem AS term, count(*) AS tf
  FROM words w JOIN stems s ON s.term = w.term
  WHERE s.stem NOT IN ({_STOP}) GROUP BY w.q_id, s.stem)"""

_GLOBAL = f"""{_STEMMED},
members AS MATERIALIZED (SELECT DISTINCT q_id FROM pos),
gdf AS (SELECT term, count(DISTINCT q_id) AS df FROM stemmed JOIN members USING (q_id) GROUP BY term),
gidf AS MATERIALIZED (SELECT term, (SELECT count(*) FROM members)::DOUBLE / df::DOUBLE AS idf
         FROM gdf WHERE df > 3),
gfeat AS MATERIALIZED (
  SELECT s.q_id, s.term,
         s.tf::DOUBLE / (sum(s.tf) OVER (PARTITION BY s.q_id))::DOUBLE * i.idf AS x
  FROM stemmed s JOIN members USING (q_id) JOIN gidf i ON i.term = s.term)"""


def _means(rows: str, groups: str, out: str) -> str:
    return (
        f"{out} AS MATERIALIZED (SELECT g.cluster_id, r.term, sum(r.x) / any_value(z.n) AS v "
        f"FROM {rows} r JOIN {groups} g ON g.q_id = r.q_id JOIN "
        f"(SELECT cluster_id, count(*) AS n FROM {groups} GROUP BY cluster_id) z "
        f"ON z.cluster_id = g.cluster_id GROUP BY g.cluster_id, r.term)"
    )


def _nearest(rows: str, docs: str, centroids: str, out: str) -> str:
    """Every document against every centroid."""
    return f"""{out}_norm AS (SELECT cluster_id, sum(v * v) AS norm FROM {centroids} GROUP BY cluster_id),
{out}_dot AS (SELECT r.q_id, c.cluster_id, sum(r.x * c.v) AS dot
  FROM {rows} r JOIN {centroids} c ON c.term = r.term GROUP BY r.q_id, c.cluster_id),
{out} AS MATERIALIZED (SELECT q_id, cluster_id FROM (
  SELECT d.q_id, n.cluster_id, row_number() OVER (PARTITION BY d.q_id
         ORDER BY n.norm - 2 * coalesce(t.dot, 0), n.cluster_id) AS r
  FROM {docs} d CROSS JOIN {out}_norm n
  LEFT JOIN {out}_dot t ON t.q_id = d.q_id AND t.cluster_id = n.cluster_id) WHERE r = 1)"""


_TAG_GROUPS = """
tag_no AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS no FROM (SELECT DISTINCT tag FROM pos)),
tag_groups AS (SELECT t.no AS cluster_id, p.q_id FROM pos p JOIN tag_no t ON t.tag = p.tag)"""
_CLUSTERED = ",\n".join([
    _GLOBAL, _TAG_GROUPS, _means("gfeat", "tag_groups", "cent"),
    _nearest("gfeat", "members", "cent", "placed"),
])
_CLUSTER_TAGS = """cluster_tags AS (SELECT DISTINCT p.cluster_id, qt.tag
  FROM placed p JOIN qt ON qt.q_id = p.q_id)"""



def _draw(round_: int, seed: int = 1) -> str:
    return f"(('0x' || substring(md5('{seed}:{round_}:' || q_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0)"


def _distances(docs: str, candidates: str, out: str) -> str:
    """Squared distances of every document and candidate document."""
    return f"""{out} AS MATERIALIZED (
  SELECT a.q_id, c.cluster_id, greatest(a.sq + b.sq - 2 * coalesce(p.dot, 0), 0) AS d
  FROM (SELECT q_id, coalesce(sq, 0) AS sq FROM {docs} LEFT JOIN sq USING (q_id)) a CROSS JOIN {candidates} c
  JOIN sq b ON b.q_id = c.q_id
  LEFT JOIN (SELECT x.q_id, k.cluster_id, sum(x.x * y.x) AS dot FROM gfeat x JOIN gfeat y ON y.term = x.term
             JOIN {candidates} k ON k.q_id = y.q_id GROUP BY x.q_id, k.cluster_id) p
    ON p.q_id = a.q_id AND p.cluster_id = c.cluster_id)"""


def _start(k: int, rounds: int = 2, seed: int = 1, s: str = "") -> list[str]:
    """k-means|| with two rounds and the weighted reduction to k; ends in the table means0(cluster_id, term, v). ``s``: a mark of the tables' names."""
    parts = [
        f"cand0{s} AS MATERIALIZED (SELECT 0 AS cluster_id, q_id FROM sq ORDER BY {_draw(0, seed)}, q_id LIMIT 1)",
    ]
    for r in range(1, rounds + 1):
        parts += [
            _distances("(SELECT q_id FROM sq)", f"cand{r - 1}{s}", f"far{r}{s}"),
            f"near{r}{s} AS MATERIALIZED (SELECT q_id, min(d) AS d FROM far{r}{s} GROUP BY q_id)",
            f"""cand{r}{s} AS MATERIALIZED (SELECT * FROM cand{r - 1}{s} UNION ALL
  SELECT row_number() OVER (ORDER BY {_draw(r, seed)}, q_id) - 1 + (SELECT count(*) FROM cand{r - 1}{s}), q_id FROM near{r}{s}
  WHERE {_draw(r, seed)} * (SELECT sum(d) FROM near{r}{s}) < {2 * k}.0 * d)""",
        ]
    parts += [
        _distances("members", f"cand{rounds}{s}", f"spread{s}"),
        f"""weight{s} AS MATERIALIZED (SELECT cluster_id, count(*) AS w FROM (SELECT cluster_id,
  row_number() OVER (PARTITION BY q_id ORDER BY round(d, 6), cluster_id) AS r FROM spread{s}) WHERE r = 1 GROUP BY cluster_id)""",
        f"""gap{s} AS MATERIALIZED (SELECT c.cluster_id AS a, s.cluster_id AS b, round(s.d, 6) AS d
  FROM cand{rounds}{s} c JOIN spread{s} s ON s.q_id = c.q_id)""",
        f"pick1{s} AS MATERIALIZED (SELECT 0 AS no, cluster_id FROM weight{s} ORDER BY w DESC, cluster_id LIMIT 1)",
    ]
    for j in range(2, k + 1):
        parts.append(f"""pick{j}{s} AS MATERIALIZED (SELECT * FROM pick{j - 1}{s} UNION ALL SELECT {j - 1}, cluster_id FROM (
  SELECT w.cluster_id, any_value(w.w) * min(g.d) AS gain FROM weight{s} w JOIN gap{s} g ON g.a = w.cluster_id
  JOIN pick{j - 1}{s} p ON p.cluster_id = g.b GROUP BY w.cluster_id HAVING gain > 0 ORDER BY gain DESC, w.cluster_id LIMIT 1))""")
    parts.append(f"""means0{s} AS MATERIALIZED (SELECT p.no AS cluster_id, f.term, f.x AS v
  FROM pick{k}{s} p JOIN cand{rounds}{s} c ON c.cluster_id = p.cluster_id JOIN gfeat f ON f.q_id = c.q_id)""")
    return parts


_SQUARES = "sq AS MATERIALIZED (SELECT q_id, sum(x * x) AS sq FROM gfeat GROUP BY q_id)"


def _kmeans(k: int, rounds: int = 2, steps: int = 4) -> str:
    """The start and ``steps`` iterations; ends in the table final(cluster_id, q_id)."""
    parts = [_SQUARES, *_start(k, rounds)]
    for i in range(steps):
        parts += [
            _nearest("gfeat", "members", f"means{i}", f"lloyd{i}"),
            _means("gfeat", f"lloyd{i}", f"moved{i}"),
            f"""means{i + 1} AS MATERIALIZED (SELECT * FROM moved{i} UNION ALL
  SELECT * FROM means{i} WHERE cluster_id NOT IN (SELECT cluster_id FROM lloyd{i}))""",
        ]
    parts.append(_nearest("gfeat", "members", f"means{steps}", "final"))
    return ",\n".join(parts)


def _fit(k: int, runs: int = 3, max_iter: int = 1000, tol: float = 1e-6) -> str:
    """The cheapest of ``runs`` starts, each iterated until no centroid moves by more than ``tol``; ends in final(cluster_id, q_id)."""
    parts = [_SQUARES]
    for run in range(1, runs + 1):
        s = f"_{run}"
        # the rows of an iteration carry the largest squared distance that a centroid moved in it
        parts += [*_start(k, seed=run, s=s), f"""lloyd{s} AS (SELECT 0 AS i, 'Infinity'::DOUBLE AS gap, cluster_id::BIGINT AS cluster_id, term, v FROM means0{s}
  UNION ALL (WITH now AS MATERIALIZED (SELECT cluster_id, term, v FROM lloyd{s} WHERE gap > {tol * tol!r} AND i < {max_iter}),
  {_nearest("gfeat", "members", "now", "placed")},
  {_means("gfeat", "placed", "moved")},
  after AS MATERIALIZED (SELECT * FROM moved UNION ALL
    SELECT * FROM now WHERE cluster_id NOT IN (SELECT cluster_id FROM placed)),
  shift AS MATERIALIZED (SELECT max(d) AS gap FROM (SELECT sum((coalesce(a.v, 0) - coalesce(b.v, 0)) ** 2) AS d
    FROM after a FULL JOIN now b ON b.cluster_id = a.cluster_id AND b.term = a.term GROUP BY coalesce(a.cluster_id, b.cluster_id)))
  SELECT (SELECT max(i) + 1 FROM lloyd{s}), (SELECT gap FROM shift), cluster_id, term, v FROM after))""",
            f"last{s} AS MATERIALIZED (SELECT cluster_id, term, v FROM lloyd{s} WHERE i = (SELECT max(i) FROM lloyd{s}))",
            _nearest("gfeat", "members", f"last{s}", f"end{s}"),
            f"""cost{s} AS MATERIALIZED (SELECT coalesce(sum(greatest(coalesce(q.sq, 0) + n.norm - 2 * coalesce(t.dot, 0), 0)), 0) AS d
  FROM end{s} e JOIN end{s}_norm n ON n.cluster_id = e.cluster_id LEFT JOIN sq q ON q.q_id = e.q_id
  LEFT JOIN end{s}_dot t ON t.q_id = e.q_id AND t.cluster_id = e.cluster_id)"""]
    best, chosen = "(SELECT d FROM cost_1)", "1"
    for run in range(2, runs + 1):
        # starts that end alike differ by rounding only, and the first of them stays
        parts.append(f"best{run} AS MATERIALIZED (SELECT CASE WHEN c.d < {best} * (1 - 1e-9) THEN {run} ELSE {chosen} END AS run, "
                     f"CASE WHEN c.d < {best} * (1 - 1e-9) THEN c.d ELSE {best} END AS d FROM cost_{run} c)")
        best, chosen = f"(SELECT d FROM best{run})", f"(SELECT run FROM best{run})"
    ends = " UNION ALL ".join(f"SELECT cluster_id, q_id FROM end_{run} WHERE {chosen} = {run}" for run in range(1, runs + 1))
    return ",\n".join([*parts, f"final AS ({ends})"])


_SCORES = """
hits AS (SELECT t.q_id, i.tag, sum(t.tf * w.w * i.idf) / sum(t.tf) AS score
  FROM plain t JOIN heldout h ON h.q_id = t.q_id
  JOIN idf i ON i.term = t.term JOIN w20 w ON w.tag = i.tag AND w.term = i.term
  GROUP BY t.q_id, i.tag)"""
_TOP10 = f"""{_SCORES},
ranked AS (SELECT h.q_id, m.tag, coalesce(s.score, 0) AS score,
    row_number() OVER (PARTITION BY h.q_id ORDER BY coalesce(s.score, 0) DESC, m.tag) AS rank
  FROM heldout h CROSS JOIN (SELECT DISTINCT tag FROM idf) m
  LEFT JOIN hits s ON s.q_id = h.q_id AND s.tag = m.tag)
SELECT q_id, rank, tag, round(score, 6) AS score FROM ranked WHERE rank <= 10"""

_EMBED = """WITH rows AS MATERIALIZED (
  SELECT vec_id AS q_id, unnest(range(len(embedding))) AS term, unnest(embedding)::DOUBLE AS x
  FROM embeddings),
docs AS (SELECT vec_id AS q_id FROM embeddings),
groups AS (SELECT label AS cluster_id, vec_id AS q_id FROM embeddings),
""" + _means("rows", "groups", "cent") + ",\n" + _nearest("rows", "docs", "cent", "placed")

_CLEAN_TITLE = "regexp_replace({}, '<(([A-Za-z]*)|(/[A-Za-z]*))>', ' ', 'g')"
_CLEAN_BODY = (
    "regexp_replace(regexp_replace(regexp_replace({}, '&#10|&#xD;|&#xA;|\\n|\\r', '', 'g'), "
    "'<([^&]*?)>', '', 'g'), '&gt;|&lt;(/?)', '', 'g')"
)
_FLAT = "regexp_replace({}, '&#10|&#xA|\\n|\\r', ' ', 'g')"
_JOINED = "array_to_string(list_sort({}), ',')"

_TEST = "(substring(md5('11:' || q_id::VARCHAR), 1, 8) < 'cccccccc')"
_SPLIT_SVM = _svm(rows=f"(SELECT * FROM feat WHERE {_TEST})", members=f"(SELECT * FROM pairs WHERE {_TEST})")
_ACCURACY = f"""
        SELECT p.tag, round(avg(((coalesce(m.m, 0) > 0)::INTEGER = p.label)::INTEGER), 6) AS accuracy,
               count(*) AS n_test
        FROM pairs p LEFT JOIN (
          SELECT r.tag, r.q_id, sum(r.x * w.w) AS m FROM feat r
          JOIN w20 w ON w.tag = r.tag AND w.term = r.term GROUP BY r.tag, r.q_id) m
        ON m.tag = p.tag AND m.q_id = p.q_id
        WHERE NOT {_TEST.replace('q_id', 'p.q_id')} GROUP BY p.tag"""

ORACLES = {
    "tag_popularity": _with() + "SELECT tag, cnt FROM tags",
    "popular_tag_total": _with() + "SELECT count(*) AS n_tags FROM tags",
    "clean_title": f"SELECT page_id, {_FLAT.format(_CLEAN_TITLE.format('html'))} AS title FROM pages",
    "clean_body": f"SELECT page_id, {_FLAT.format(_CLEAN_BODY.format('html'))} AS body FROM pages",
    "parse_tags": f"""
        SELECT d.doc_id,
          CASE WHEN l.quality IS NOT NULL THEN lang || ',' || source || ',' || lang || ','
               ELSE lang || ',' || upper(source) || ',' END AS tag_list,
          {_JOINED.format('[lang, lower(source)]')} AS tags
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "xml_posts_round_trip": _with() + f"""
        SELECT q_id, {_FLAT.format(_CLEAN_TITLE.format('title'))} AS title,
          {_FLAT.format(_CLEAN_BODY.format('body'))} AS body, {_JOINED.format('tags')} AS tags,
          len(tags) AS answer_count, length(body) AS view_count FROM q""",
    "whitelist_subset": "WITH" + _Q + """,
        topic AS (SELECT q_id, list_filter(tags, lambda x: x <> src_file) AS tags FROM q),
        bridge AS (SELECT q_id, unnest(tags) AS tag FROM topic),
        listed AS (SELECT tag FROM bridge GROUP BY tag
                   HAVING count(*) * 10 > (SELECT count(*) FROM topic))
        SELECT q_id, """ + _JOINED.format("tags") + """ AS tags FROM topic t
        WHERE NOT EXISTS (SELECT 1 FROM bridge b WHERE b.q_id = t.q_id
                          AND b.tag NOT IN (SELECT tag FROM listed))""",
    "question_content": _with() + f"SELECT q_id, content, {_JOINED.format('tags')} AS tags FROM qc",
    "question_tag_bridge": _with() + "SELECT q_id, tag FROM qt",
    "question_tag_wide": _with() + """SELECT q_id,
          list_sort(tags)[1] AS q_tag_1, list_sort(tags)[2] AS q_tag_2, list_sort(tags)[3] AS q_tag_3,
          list_sort(tags)[4] AS q_tag_4, list_sort(tags)[5] AS q_tag_5 FROM q""",
    "chunk_ids": _with() + """SELECT q_id,
          ((row_number() OVER (ORDER BY q_id) - 1) // 400)::INTEGER AS chunk_id FROM q""",
    "file_sizes": _with() + """SELECT src_file, count(*) AS n, floor(count(*) * 0.1)::BIGINT AS n_holdout
          FROM q GROUP BY src_file""",
    "holdout_split": _with() + "SELECT q_id, src_file, split FROM split",
    "holdout_rows": _with() + f"SELECT q_id, content, {_JOINED.format('tags')} AS tags FROM heldout",
    "point_lookup": _with() + "SELECT q_id, title FROM q WHERE q_id IN (SELECT doc_id FROM labels)",
    "positives": _with() + "SELECT tag, q_id FROM pos",
    "negatives": _with() + "SELECT tag, q_id FROM neg",
    "segment_counts": _with() + "SELECT tag, label, count(*) AS n_docs FROM pairs GROUP BY tag, label",
    "training_rows": _with() + """SELECT p.tag, p.label, p.q_id, c.content,
          CASE WHEN p.label = 1 THEN p.tag ELSE 'NOT_' || p.tag END AS label_text
          FROM pairs p JOIN qc c ON c.q_id = p.q_id""",
    "training_rows_with_label_text": _with() + """SELECT tag, label, q_id,
          content || ' ' || label_text AS content, label_text FROM (
            SELECT p.tag, p.label, p.q_id, c.content,
              CASE WHEN p.label = 1 THEN p.tag ELSE 'NOT_' || p.tag END AS label_text
            FROM pairs p JOIN qc c ON c.q_id = p.q_id)""",
    "tokens_plain": _with() + f"""
        SELECT q_id, len(t) AS n_terms, array_to_string(t, ' ') AS terms FROM (
          SELECT q_id, list_filter(list_transform(regexp_extract_all(content, '\\p{{L}}{{1,255}}'),
            lambda x: lower(x)), lambda x: length(x) BETWEEN 3 AND 100 AND x NOT IN ({_STOP})) AS t
          FROM qc)""",
    "tokens_stem": _with(_WORDS, _stem_ctes("words")) + "SELECT term, stem FROM stems",
    "term_counts_plain": _with(_PLAIN) + "SELECT q_id, term, tf FROM plain",
    "postings": _with(_STEMMED) + "SELECT term, q_id, tf FROM stemmed WHERE q_id IN (SELECT q_id FROM indexed)",
    "vocabulary": _with(_PLAIN) + """SELECT tag, term,
          row_number() OVER (PARTITION BY tag ORDER BY term) - 1 AS term_id
          FROM (SELECT DISTINCT p.tag, t.term FROM pairs p JOIN plain t ON p.q_id = t.q_id)""",
    "doc_frequency": _with(_PLAIN, _PER_TAG) + "SELECT tag, term, df FROM dfs",
    "idf": _with(_PLAIN, _PER_TAG) + "SELECT tag, term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_per_tag": _with(_PLAIN, _PER_TAG) + "SELECT tag, q_id, term, round(x, 6) AS x FROM feat",
    "tfidf_global": _with(_GLOBAL) + "SELECT q_id, term, round(x, 6) AS x FROM gfeat",
    "svm_weights": _with(_PLAIN, _PER_TAG, _svm()) + "SELECT tag, term, round(w, 6) AS w FROM w20",
    "svm_margins": _with(_PLAIN, _PER_TAG, _svm()) + """
        SELECT p.tag, p.q_id, p.label, round(coalesce(m.m, 0), 6) AS margin FROM pairs p LEFT JOIN (
          SELECT r.tag, r.q_id, sum(r.x * w.w) AS m FROM rows r
          JOIN w20 w ON w.tag = r.tag AND w.term = r.term GROUP BY r.tag, r.q_id) m
        ON m.tag = p.tag AND m.q_id = p.q_id""",
    "recommend_top10": _with(_PLAIN, _PER_TAG, _svm(), _TOP10.strip()),
    "split_80_20": _with() + f"SELECT q_id, {_TEST} AS in_train FROM q",
    "accuracy_report": _with(_PLAIN, _PER_TAG, _SPLIT_SVM) + _ACCURACY,
    "embedding_assign": _EMBED + "SELECT q_id, cluster_id FROM placed",
    "embedding_lloyd_step": _EMBED + ",\n" + _means("rows", "placed", "moved")
    + "SELECT cluster_id, term AS dim, round(v, 6) AS v FROM moved",
    "kmeans_assign": _with(_CLUSTERED) + "SELECT q_id, cluster_id FROM placed",
    "kmeans_fit": _with(_GLOBAL, _fit(6)).replace("WITH", "WITH RECURSIVE", 1) + "SELECT cluster_id, count(*) AS n_docs FROM final GROUP BY cluster_id",
    "kmeans_start": _with(_GLOBAL, _kmeans(6, steps=0)) + "SELECT cluster_id, term, round(v, 6) AS v FROM means0",
    "lloyd_step": _with(_CLUSTERED, _means("gfeat", "placed", "moved"),
        "empty AS (SELECT * FROM cent WHERE cluster_id NOT IN (SELECT cluster_id FROM placed))")
    + """SELECT cluster_id, term, round(v, 6) AS v FROM moved
         UNION ALL SELECT cluster_id, term, round(v, 6) FROM empty""",
    "cluster_members": _with(_CLUSTERED)
    + "SELECT cluster_id, count(*) AS n_docs FROM placed GROUP BY cluster_id",
    "cluster_tag_set": _with(_CLUSTERED, _CLUSTER_TAGS) + "SELECT cluster_id, tag FROM cluster_tags",
    "recommend_routed_top5": ",\n".join([
        _with(_PLAIN, _PER_TAG).rstrip(),
        _svm().replace("members", "smembers"), _CLUSTERED, _CLUSTER_TAGS, _SCORES.strip(),
        """hfeat AS MATERIALIZED (SELECT s.q_id, s.term,
             s.tf::DOUBLE / (sum(s.tf) OVER (PARTITION BY s.q_id))::DOUBLE * i.idf AS x
           FROM stemmed s JOIN heldout h ON h.q_id = s.q_id JOIN gidf i ON i.term = s.term)""",
        _nearest("hfeat", "heldout", "cent", "routed"),
    ]) + """
        SELECT q_id, cluster_id, rank, tag, round(score, 6) AS score FROM (
          SELECT r.q_id, r.cluster_id, c.tag, coalesce(s.score, 0) AS score,
            row_number() OVER (PARTITION BY r.q_id ORDER BY coalesce(s.score, 0) DESC, c.tag) AS rank
          FROM routed r JOIN cluster_tags c ON c.cluster_id = r.cluster_id
          JOIN (SELECT DISTINCT tag FROM idf) m ON m.tag = c.tag
          LEFT JOIN hits s ON s.q_id = r.q_id AND s.tag = c.tag)
        WHERE rank <= 5""",
}
ORACLES["stream_recommend"] = ORACLES["recommend_top10"]


# --- through files ----------------------------------------------------------------------


def _command(*parts: str, blank: str = "{}") -> str:
    """``_with`` over the questions that the commands accept: cleaned, with listed tags only, in chunks of 200,000.

    ``blank``: what a file form makes of an element's text.
    """
    flat_title = blank.format(_FLAT.format(_CLEAN_TITLE.format("title")))
    flat_body = blank.format(_FLAT.format(_CLEAN_BODY.format("body")))
    questions = _Q.replace("q AS (", "raw AS (", 1) + f""",
rawt AS (SELECT DISTINCT q_id, unnest(tags) AS tag FROM raw),
tags AS (SELECT lower(tag) AS tag, count(DISTINCT q_id) AS cnt FROM rawt
         WHERE lower(tag) <> 'src7' GROUP BY lower(tag) HAVING cnt > 9),
q AS (SELECT q_id, {flat_title} AS title, {flat_body} AS body, list_distinct(tags) AS tags,
        (row_number() OVER (ORDER BY q_id) - 1) // 200000 AS src_file, q_id AS pos
      FROM raw WHERE q_id NOT IN (SELECT q_id FROM rawt WHERE tag NOT IN (SELECT tag FROM tags)))"""
    return ",\n".join(["WITH" + questions, _QT, _CONTENT, _SPLIT, _PAIRS, *parts]) + "\n"


_ELEMENT = "nullif(trim({}), '')"
_COMMAND_CLUSTERS = _command(_GLOBAL, _kmeans(4, steps=3))
_OWN_TAGS = "own AS (SELECT DISTINCT f.cluster_id, qt.tag FROM final f JOIN qt ON qt.q_id = f.q_id JOIN indexed i ON i.q_id = f.q_id)"

ORACLES |= {
    "tag_file_round_trip": _command() + """
        SELECT upper(tag) AS tag, (SELECT count(*) FROM tags) AS n_written FROM tags
        UNION ALL SELECT tag, (SELECT count(*) FROM tags) FROM tags""",
    "command_index": _command(blank=_ELEMENT)
    + f"SELECT q_id, content, {_JOINED.format('tags')} AS tags, split FROM split",
    "command_training_set": _command() + "SELECT tag, label, q_id FROM pairs",
    "command_models": _command(_PLAIN, _PER_TAG, _svm()) + """
        SELECT w.tag, w.term, round(w.w, 6) AS w, round(i.idf, 6) AS idf
        FROM w20 w JOIN idf i ON i.tag = w.tag AND i.term = w.term""",
    "command_report": "SELECT tag, accuracy FROM (" + _command(_PLAIN, _PER_TAG, _SPLIT_SVM) + _ACCURACY + ")",
    "command_recommend": _command(_PLAIN, _PER_TAG, _svm(), _TOP10.strip()),
    "command_clusters": _COMMAND_CLUSTERS + """
        SELECT m.cluster_id, m.term, round(m.v, 6) AS v, g.df FROM means3 m JOIN gdf g ON g.term = m.term""",
    "command_cluster_tags": _COMMAND_CLUSTERS.rstrip() + ",\n" + _OWN_TAGS + " SELECT cluster_id, tag FROM own",
    "command_recommend_routed": ",\n".join([
        _command(_PLAIN, _PER_TAG).rstrip(), _svm().replace("members", "smembers"),
        _GLOBAL, _kmeans(4, steps=3), _OWN_TAGS, _SCORES.strip(),
        """hfeat AS MATERIALIZED (SELECT s.q_id, s.term,
             s.tf::DOUBLE / (sum(s.tf) OVER (PARTITION BY s.q_id))::DOUBLE * i.idf AS x
           FROM stemmed s JOIN heldout h ON h.q_id = s.q_id JOIN gidf i ON i.term = s.term)""",
        _nearest("hfeat", "heldout", "means3", "routed"),
    ]) + """
        SELECT q_id, cluster_id, rank, tag, round(score, 6) AS score FROM (
          SELECT r.q_id, r.cluster_id, c.tag, coalesce(s.score, 0) AS score,
            row_number() OVER (PARTITION BY r.q_id ORDER BY coalesce(s.score, 0) DESC, c.tag) AS rank
          FROM routed r JOIN own c ON c.cluster_id = r.cluster_id
          JOIN (SELECT DISTINCT tag FROM idf) m ON m.tag = c.tag
          LEFT JOIN hits s ON s.q_id = r.q_id AND s.tag = c.tag)
        WHERE rank <= 5""",
    "question_xml_files": _with() + f"""
        SELECT q_id, {_ELEMENT.format('title')} AS title, {_ELEMENT.format(_CLEAN_BODY.format('body'))} AS body,
          {_JOINED.format('tags')} AS tags, len(tags) AS answer_count, length(body) AS view_count FROM q""",
    "holdout_file": _with() + f"""
        SELECT q_id, regexp_replace(content, '[\\t\\r\\n]', ' ', 'g') AS content, {_JOINED.format('tags')} AS tags FROM heldout""",
    "cluster_assign_file": ORACLES["embedding_assign"],
    "cluster_tag_files": _with(_EMBED.removeprefix("WITH "))
    + "SELECT DISTINCT p.cluster_id, qt.tag FROM placed p JOIN qt ON qt.q_id = p.q_id",
}
