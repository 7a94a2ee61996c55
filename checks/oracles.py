"""DuckDB counterparts of the registered queries, written from the rules and independent of the Spark code."""

from __future__ import annotations

from checks import file_queries

M = """
k AS (SELECT unnest([0, 1, 2, 3]) k),
v AS (SELECT vec_id * 4 + k AS fid, vec_id AS owner,
  list_transform(embedding, lambda x, i: CASE WHEN ((i - 1) * 29 + vec_id * 11 + k * 17) % 64 < (vec_id % 5) * k
    THEN -0.25 * x ELSE x END::DOUBLE) w FROM embeddings, k),
n AS (SELECT fid, owner, w, sqrt(list_sum(list_transform(w, lambda x: x * x))) nrm FROM v),
m AS MATERIALIZED (SELECT CAST(fid AS VARCHAR) AS file_id, fid, owner,
  concat('/library/', lpad(CAST(fid AS VARCHAR), 9, '0'), '.jpg') AS path,
  list_transform(w, lambda x: x / nrm) AS vector,
  md5(CASE WHEN owner % 5 = 0 THEN concat('o', owner) ELSE concat('f', fid) END) AS md5,
  list_reduce(list_transform(w, lambda x, i: CASE WHEN x <= 0 THEN 0::BIGINT
    WHEN i = 1 THEN (-9223372036854775807 - 1)::BIGINT ELSE (1::BIGINT << (64 - i)) END), lambda a, x: a | x) AS phash
  FROM n)"""

D = """
d AS (
SELECT doc_id AS file_id, concat('p', doc_id % 3) AS project_id,
 concat(CASE doc_id % 4 WHEN 0 THEN '/library/' WHEN 1 THEN '/library2/' ELSE '/media/' END,
  source, '/', lang, '/', doc_id, '/IMG_', doc_id % 50, '.',
  CASE doc_id % 7 WHEN 0 THEN 'jpg' WHEN 1 THEN 'PNG' WHEN 2 THEN 'heic' WHEN 3 THEN 'mp4'
   WHEN 4 THEN 'mp3' WHEN 5 THEN 'txt' ELSE 'TIF' END) AS path,
 n_chars AS file_size, md5(text) AS md5,
 CASE doc_id % 5 WHEN 0 THEN NULL
  WHEN 1 THEN concat(2020 + doc_id % 6, '-', lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0'), '-',
   lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0'), 'T10:20:30')
  WHEN 2 THEN concat(2020 + doc_id % 6, '-', lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0'), '-',
   lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0'), 'T10:20:30.5+00:00')
  WHEN 3 THEN concat(2020 + doc_id % 6, '-', lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0'), '-',
   lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0'), ' 10:20:30')
  ELSE 'unknown' END AS taken_at,
 concat(2020 + doc_id % 6, ':', lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0'), ':05 07:08:09') AS exif_raw
FROM documents),
x AS (SELECT *, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext,
  regexp_extract(path, '([^/]*)$', 1) AS file_name FROM d),
t AS (SELECT *, CASE WHEN ext IN ('jpg', 'jpeg', 'png', 'heic', 'webp', 'bmp', 'tiff', 'tif') THEN 'image'
  WHEN ext IN ('mp4', 'mov', 'avi', 'mkv', 'wmv', 'flv', 'webm') THEN 'video'
  WHEN ext IN ('mp3', 'wav', 'flac', 'aac', 'ogg', 'wma', 'm4a') THEN 'audio' END AS file_type FROM x),
c AS (SELECT * FROM t WHERE file_type IS NOT NULL),
l AS (SELECT path, file_size, file_type FROM c WHERE file_id % 9 <> 0
  UNION ALL SELECT concat('/media/new/', file_id + 1000000, '.jpg'), file_size, 'image' FROM c WHERE file_id % 11 = 0)"""

DATE = """CASE WHEN len(string_split(split_part(split_part(taken_at, 'T', 1), ' ', 1), '-')) >= 3
  THEN string_split(split_part(split_part(taken_at, 'T', 1), ' ', 1), '-') END"""

PROJECTS = """
pr AS (SELECT CAST(c_custkey AS VARCHAR) AS project_id, c_name AS name,
  1500000000 + (c_custkey * 7919) % 100003 AS created FROM customer),
rt AS (SELECT CAST(o_orderkey AS VARCHAR) AS root_id, CAST(o_custkey AS VARCHAR) AS project_id,
  concat('/vol/', o_orderpriority, '/', o_orderkey % 3) AS path, o_orderdate AS created, o_orderstatus FROM orders)"""

GROUPS = """
h AS (SELECT md5, min(file_id) AS head, count(*) AS group_size FROM c GROUP BY md5 HAVING count(*) >= 2),
g AS (SELECT c.*, lpad(CAST(head AS VARCHAR), 12, '0') AS group_id, group_size,
  row_number() OVER (PARTITION BY head ORDER BY file_size DESC, path) - 1 AS position
  FROM c JOIN h USING (md5))"""

# One pass over ranked pairs: ``lab`` names the cluster of every file, a step merges two clusters when all
# their cross pairs satisfy the predicate.
GREEDY = """
{name}s AS (
  SELECT 0::BIGINT AS k, {start} AS lab, 0::BIGINT AS merged
  UNION ALL
  SELECT k, CASE WHEN live THEN list_transform(lab, lambda z: CASE WHEN z = lj THEN li ELSE z END) ELSE lab END,
    merged + live::BIGINT
  FROM (
    SELECT q.k, q.lab, q.merged, q.li, q.lj, q.li <> q.lj AND
      len(list_filter(q.pa, lambda x: len(list_filter(q.pb, lambda y: NOT ({similar}))) > 0)) = 0 AS live
    FROM (
      SELECT p.k, s.lab, s.merged, s.lab[p.i] AS li, s.lab[p.j] AS lj,
        list_filter(range(1, len(s.lab) + 1), lambda x: s.lab[x] = s.lab[p.i]) AS pa,
        list_filter(range(1, len(s.lab) + 1), lambda x: s.lab[x] = s.lab[p.j]) AS pb
      FROM {name}s s JOIN {pairs} p ON p.k = s.k + 1
    ) q, cst
  )
),
{name} AS MATERIALIZED (SELECT lab, merged FROM {name}s ORDER BY k DESC LIMIT 1)"""

RANKED = M + """,
r AS (SELECT row_number() OVER (ORDER BY phash, path) AS i, * FROM m),
r5 AS MATERIALIZED (SELECT *, min(i) OVER (PARTITION BY md5) AS unit FROM r),
cst AS MATERIALIZED (SELECT list(phash ORDER BY i) AS hs, list(vector ORDER BY i) AS vs, list(unit ORDER BY i) AS us FROM r5),
ap AS MATERIALIZED (SELECT a.i AS i, b.i AS j, bit_count(xor(a.phash, b.phash)) AS d FROM r5 a JOIN r5 b ON a.i < b.i AND a.unit <> b.unit),
p8 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d, i, j) AS k, i, j FROM ap WHERE d <= 8)"""

HASH_RUN = RANKED + "," + GREEDY.format(
    name="g8", start="us FROM cst", pairs="p8", similar="bit_count(xor(hs[x], hs[y])) <= 8"
).replace("SELECT 0::BIGINT AS k, us FROM cst AS lab, 0::BIGINT AS merged", "SELECT 0::BIGINT AS k, us AS lab, 0::BIGINT AS merged FROM cst")

NAMED = """
fin AS MATERIALIZED (SELECT r5.*, f.lab[r5.i] AS cl FROM r5, {name} f),
nm AS (SELECT cl, min(file_id) AS group_id, count(*) AS cnt FROM fin GROUP BY cl HAVING count(*) >= 2)"""

# Evicted files leave their group before suspects are confirmed: each gets a cluster of its own.
COMBINED_RUN = HASH_RUN + """,
f8 AS (SELECT r5.i, r5.vector, g8.lab[r5.i] AS cl FROM r5, g8),
low AS (SELECT a.i, min(list_inner_product(a.vector, b.vector)) AS sim FROM f8 a JOIN f8 b ON a.cl = b.cl AND a.i <> b.i GROUP BY a.i),
l2 AS (SELECT list(CASE WHEN low.sim < 0.93 THEN f8.i + 1000000000 ELSE f8.cl END ORDER BY f8.i) AS lab0 FROM f8 LEFT JOIN low ON low.i = f8.i),
sp AS (SELECT ap.i, ap.j, list_inner_product(a.vector, b.vector) AS sim FROM ap JOIN r5 a ON a.i = ap.i JOIN r5 b ON b.i = ap.j WHERE d > 8 AND d <= 12),
p12 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY i, j) AS k, i, j FROM sp WHERE sim >= 0.93),""" + GREEDY.format(
    name="g12",
    start="lab0",
    pairs="p12",
    similar="bit_count(xor(hs[x], hs[y])) <= 12 AND list_inner_product(vs[x], vs[y]) >= 0.93",
).replace("lab0 AS lab, 0::BIGINT AS merged", "lab0 AS lab, 0::BIGINT AS merged FROM l2")

VECTOR_RUN = RANKED + """,
vp AS (SELECT ap.i, ap.j, round(list_inner_product(a.vector, b.vector), 9) AS sim FROM ap JOIN r5 a ON a.i = ap.i JOIN r5 b ON b.i = ap.j),
pv AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sim DESC, i, j) AS k, i, j FROM vp WHERE sim >= 0.93),""" + GREEDY.format(
    name="gv", start="us", pairs="pv", similar="list_inner_product(vs[x], vs[y]) >= 0.93"
).replace("us AS lab, 0::BIGINT AS merged", "us AS lab, 0::BIGINT AS merged FROM cst")

MEMBERS = "SELECT file_id, group_id FROM fin JOIN nm USING (cl)"

PLAN = D + f""",
s AS (SELECT *, {DATE} AS dp, row_number() OVER (PARTITION BY md5 ORDER BY taken_at NULLS FIRST, path) AS rn FROM c
  WHERE NOT starts_with(path, '/library') AND file_type IN ('image', 'video') AND path IN (SELECT path FROM l)),
w AS (SELECT c.file_id, c.path, c.file_name, c.taken_at, s.dp,
  CASE WHEN s.path IS NULL THEN 'source_missing'
    WHEN c.md5 IN (SELECT md5 FROM c WHERE starts_with(path, '/library') AND path IN (SELECT path FROM l)) OR s.rn > 1 THEN 'same_content'
    WHEN c.taken_at IS NULL THEN 'no_date' WHEN s.dp IS NULL THEN 'bad_date' END AS skip_reason
  FROM c LEFT JOIN s ON s.path = c.path
  WHERE NOT starts_with(c.path, '/library') AND c.file_type IN ('image', 'video')),
y AS (SELECT *, CASE WHEN skip_reason IS NULL THEN concat('/library/', dp[1], '/', dp[2], '/', file_name) END AS dest FROM w),
z AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY taken_at NULLS FIRST, path) AS nth FROM y),
pl AS (SELECT file_id, path, 'move' AS action, CASE WHEN skip_reason IS NULL THEN 'ready' ELSE 'skipped' END AS status, skip_reason,
  CASE WHEN skip_reason IS NOT NULL THEN NULL WHEN nth = 1 AND dest NOT IN (SELECT path FROM l) THEN dest
    ELSE regexp_replace(dest, '\\.([^.]*)$', concat('_', substr(md5(path), 1, 6), '.\\1')) END AS dest_path FROM z)"""

DECISIONS = D + "," + GROUPS + """,
o AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS ord FROM (SELECT DISTINCT group_id FROM g)),
pk AS (SELECT group_id, min(file_id) FILTER (file_id % 3 = 0) AS m0, min(file_id) FILTER (file_id % 3 = 1) AS m1,
  min(file_id) FILTER (file_id % 3 = 2) AS m2, min(file_id) AS m FROM g GROUP BY group_id),
a AS (SELECT ord, group_id, event_id AS seq, event_type AS e,
  coalesce(CASE event_id % 3 WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END, m) AS f
  FROM events JOIN o ON user_id = ord JOIN pk USING (group_id)),
fa AS (SELECT g.group_id, g.file_id, g.file_size, g.position, o.ord,
  (SELECT max(seq) FROM a WHERE (a.ord = o.ord AND e IN ('click', 'purchase', 'error')) OR (e = 'signup' AND a.ord <= o.ord)) AS since
  FROM g JOIN o USING (group_id)),
de AS (SELECT fa.group_id, fa.file_id, fa.file_size,
  (CASE WHEN s.e IS NULL THEN fa.position = 0 WHEN s.e = 'error' THEN FALSE WHEN s.e = 'click' THEN s.f = fa.file_id ELSE TRUE END)
   <> ((SELECT count(*) FROM a WHERE a.e = 'view' AND a.f = fa.file_id AND a.seq > coalesce(fa.since, -1)) % 2 = 1) AS keep
  FROM fa LEFT JOIN a s ON s.seq = fa.since)"""


# First fit over the members of each group in order; ``parts`` holds the values placed so far.
FIRST_FIT = """
it AS MATERIALIZED ({members}),
fs AS (
  SELECT grp, 0::BIGINT AS k, NULL::VARCHAR AS id, []::{kind}[][] AS parts, 0::BIGINT AS part FROM (SELECT DISTINCT grp FROM it)
  UNION ALL
  SELECT grp, k, id, CASE WHEN home IS NULL THEN list_append(parts, [value])
      ELSE list_transform(parts, lambda x, i: CASE WHEN i = home THEN list_append(x, value) ELSE x END) END,
    coalesce(home - 1, len(parts))
  FROM (SELECT it.grp, it.k, it.id, it.value, fs.parts,
      list_filter(range(1, len(fs.parts) + 1), lambda i: len(list_filter(fs.parts[i], lambda y: NOT ({fits}))) = 0)[1] AS home
    FROM fs JOIN it ON it.grp = fs.grp AND it.k = fs.k + 1))"""


def _with(parts: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts.strip()}\n{body}"


SUMMARY = """SELECT (SELECT count(*) FROM r5)::BIGINT AS total_target_images, (SELECT count(*) FROM nm)::BIGINT AS groups_found,
  (SELECT sum(cnt) FROM nm)::BIGINT AS total_duplicates, '{methods}' AS methods,
  (SELECT count(*) FROM {checked})::BIGINT AS suspect_pairs_checked, (SELECT merged FROM {name})::BIGINT AS ai_confirmed"""

_HASH_PAIRS = """, u AS (SELECT DISTINCT phash AS h FROM m),
hp AS (SELECT a.h AS a, b.h AS b, bit_count(xor(a.h, b.h))::INTEGER AS dist FROM u a JOIN u b ON a.h < b.h)"""

ORACLES: dict[str, str] = {
    "classify_extension": _with(D, "SELECT file_id, file_type FROM t"),
    "file_name": _with(
        D, "SELECT file_id, file_name, ext, left(file_name, length(file_name) - length(ext) - 1) AS stem FROM x"
    ),
    "normalize_exif_date": _with(
        D, "SELECT file_id, concat(substr(exif_raw, 1, 4), '-', substr(exif_raw, 6, 2), '-', substr(exif_raw, 9, 2), 'T', substr(exif_raw, 12)) AS taken FROM d"
    ),
    "taken_at_fallback": _with(
        D,
        """SELECT file_id, CASE WHEN file_type = 'image' AND file_id % 4 = 0
  THEN concat(replace(substr(exif_raw, 1, 10), ':', '-'), 'T', substr(exif_raw, 12))
  ELSE strftime(make_timestamp((1600000000 + file_id * 3607) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS taken_at FROM t""",
    ),
    "content_md5": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "gradient_hash_array": """WITH b AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS e FROM embeddings)
SELECT vec_id, list_reduce(list_transform(range(0, 64), lambda p: CASE WHEN NOT e[p + p // 8 + 1] < e[p + p // 8 + 2] THEN 0::BIGINT
  WHEN p = 0 THEN (-9223372036854775807 - 1)::BIGINT ELSE (1::BIGINT << (63 - p)) END), lambda a, z: a | z) AS phash FROM b""",
    "l2_normalize": """WITH b AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda z: z * z))) AS nrm FROM b)
SELECT vec_id, (unnest(range(1, len(e) + 1)) - 1)::INTEGER AS pos,
  round(unnest(list_transform(e, lambda z: CASE WHEN nrm < 1e-8 THEN z ELSE z / nrm END)), 6) AS x FROM n""",
    "date_parts": _with(D, f"SELECT file_id, dp[1] AS year, dp[2] AS month, dp[3] AS day FROM (SELECT file_id, {DATE} AS dp FROM d)"),
    "date_template_all": _with(
        D,
        f"""SELECT file_id, template, CASE WHEN dp IS NOT NULL THEN replace(replace(replace(template, 'YYYY', dp[1]), 'MM', dp[2]), 'DD', dp[3]) END AS folder
FROM (SELECT file_id, {DATE} AS dp FROM d), (SELECT unnest(['YYYY/MM/DD', 'YYYY/MM', 'YYYY_MM', 'YYYY-MM/DD', 'YYYY_MM/DD', 'YYYY/YYYY-MM-DD', 'YYYY']) AS template)""",
    ),
    "relative_folder": _with(
        D,
        """SELECT file_id, CASE WHEN NOT starts_with(f, '/library') THEN f WHEN ltrim(substr(f, 9), '/') = '' THEN '/'
  ELSE regexp_replace(substr(f, 9), '^/', '') END AS folder FROM (SELECT file_id, regexp_replace(path, '/[^/]*$', '') AS f FROM d)""",
    ),
    "under_dir_counts": _with(
        D,
        """SELECT project_id, count(*) FILTER (path LIKE '/library%') AS by_prefix, count(*) FILTER (path LIKE '/library/%') AS by_folder,
  count(*) FILTER (path ILIKE '/LIBRARY%') AS any_case, count(*) FILTER (path LIKE '/library2%') AS backslash FROM d GROUP BY 1""",
    ),
    "type_filter": _with(D, "SELECT file_id, file_type FROM c WHERE file_type IN ('image', 'audio')"),
    "hamming_pairs_le8": _with(M + _HASH_PAIRS, "SELECT * FROM hp WHERE dist <= 8"),
    "hamming_pairs_banded": _with(M + _HASH_PAIRS, "SELECT * FROM hp WHERE dist <= 8"),
    "hamming_two_band": _with(M + _HASH_PAIRS, "SELECT *, dist <= 8 AS sure FROM hp WHERE dist <= 12"),
    "cosine_pairs": _with(
        M,
        """SELECT a.fid AS a, b.fid AS b, round(list_inner_product(a.vector, b.vector), 9) AS sim FROM m a JOIN m b ON a.fid < b.fid
WHERE list_inner_product(a.vector, b.vector) >= 0.93""",
    ),
    "hamming_pairs_pivots": _with(M + _HASH_PAIRS, "SELECT * FROM hp WHERE dist <= 12"),
    "cosine_pairs_pivots": _with(
        M,
        """SELECT a.fid AS a, b.fid AS b, round(list_inner_product(a.vector, b.vector), 9) AS sim FROM m a JOIN m b ON a.fid < b.fid
WHERE list_inner_product(a.vector, b.vector) >= 0.93""",
    ),
    "similarity_components": _with(
        M + _HASH_PAIRS
        + """, e AS (SELECT a, b FROM hp WHERE dist <= 8 UNION ALL SELECT b, a FROM hp WHERE dist <= 8),
reach AS (SELECT DISTINCT a AS node, a AS tip FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.tip)""",
        "SELECT node, min(tip) AS component FROM reach GROUP BY node",
        recursive=True,
    ),
    "md5_groups": _with(D, "SELECT file_id, min(file_id) OVER (PARTITION BY md5) AS md5_group FROM d"),
    "path_key_first": _with(
        D
        + """, b AS (SELECT file_id, path, file_size % 97 AS phash FROM d
  UNION ALL SELECT file_id + 5000000, replace(upper(path), '/', '\\'), ((file_size % 97) * 31) % 97 FROM d)""",
        """SELECT file_id, path, phash FROM (SELECT *, row_number() OVER (PARTITION BY lower(replace(path, '\\', '/')) ORDER BY phash, path) AS rn FROM b)
WHERE rn = 1""",
    ),
    "need_vectors": _with(
        M + _HASH_PAIRS
        + """, s AS (SELECT a AS h FROM hp WHERE dist > 8 AND dist <= 12 UNION SELECT b FROM hp WHERE dist > 8 AND dist <= 12
  UNION SELECT phash FROM m GROUP BY phash HAVING count(*) >= 2)""",
        "SELECT file_id FROM m WHERE phash IN (SELECT h FROM s)",
    ),
    "verify_evictions": _with(
        M,
        """SELECT file_id FROM m WHERE fid % 17 = 0 UNION ALL
SELECT a.file_id FROM m a JOIN m b ON a.owner = b.owner AND a.fid <> b.fid WHERE a.fid % 17 <> 0 AND b.fid % 17 <> 0
GROUP BY a.file_id HAVING min(list_inner_product(a.vector, b.vector)) < 0.93""",
    ),
    "phash_validation": _with(
        M,
        """SELECT a.file_id FROM m a JOIN m b ON a.owner = b.owner AND a.fid <> b.fid
GROUP BY a.file_id HAVING max(bit_count(xor(a.phash, b.phash))) > 12""",
    ),
    "oversized_split_phash": _with(
        M
        + ","
        + FIRST_FIT.format(
            members="""SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY pos, id) AS k, id, value
  FROM (SELECT owner % 25 AS grp, phash AS value, CAST(phash AS VARCHAR) AS id, min(path) AS pos FROM m GROUP BY 1, 2)""",
            kind="BIGINT",
            fits="bit_count(xor(y, it.value)) <= 4",
        ),
        "SELECT grp, id, part FROM fs WHERE k > 0",
        recursive=True,
    ),
    "oversized_split_cosine": _with(
        M
        + ","
        + FIRST_FIT.format(
            members="SELECT owner % 25 AS grp, row_number() OVER (PARTITION BY owner % 25 ORDER BY path, file_id) AS k, file_id AS id, vector AS value FROM m",
            kind="DOUBLE[]",
            fits="list_inner_product(y, it.value) >= 0.965",
        ),
        "SELECT grp, id, part FROM fs WHERE k > 0",
        recursive=True,
    ),
    "dedup_phash": _with(HASH_RUN + "," + NAMED.format(name="g8"), MEMBERS, recursive=True),
    "dedup_phash_levels": _with(HASH_RUN + "," + NAMED.format(name="g8"), MEMBERS, recursive=True),
    "dedup_phash_ai": _with(COMBINED_RUN + "," + NAMED.format(name="g12"), MEMBERS, recursive=True),
    "dedup_ai": _with(VECTOR_RUN + "," + NAMED.format(name="gv"), MEMBERS, recursive=True),
    "dedup_summary": _with(
        COMBINED_RUN + "," + NAMED.format(name="g12"), SUMMARY.format(methods="pHash+vector", checked="sp", name="g12"), recursive=True
    ),
    "dedup_summary_ai": _with(
        VECTOR_RUN + "," + NAMED.format(name="gv"), SUMMARY.format(methods="vector", checked="pv", name="gv"), recursive=True
    ),
    "scan_summary": _with(
        D,
        """SELECT count(*) AS total_files, count(*) FILTER (file_type = 'image') AS images, count(*) FILTER (file_type = 'video') AS videos,
  count(*) FILTER (file_type = 'audio') AS audios FROM l""",
    ),
    "source_type_counts": _with(
        D,
        """SELECT project_id, count(*) FILTER (file_type = 'image') AS images, count(*) FILTER (file_type = 'video') AS videos,
  count(*) FILTER (file_type = 'audio') AS audios FROM c WHERE NOT starts_with(path, '/library') GROUP BY 1""",
    ),
    "incremental_new_files": _with(D, "SELECT path FROM l WHERE path NOT IN (SELECT path FROM c WHERE project_id = 'p1')"),
    "catalog_append": _with(
        D
        + """, b AS (SELECT path, md5(path) AS file_id, file_size FROM l UNION ALL SELECT path, md5(upper(path)), file_size + 1 FROM l)""",
        """SELECT path, file_id, file_size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY file_id) AS rn FROM b
  WHERE path NOT IN (SELECT path FROM c WHERE project_id = 'p0')) WHERE rn = 1""",
    ),
    "one_row_per_path": _with(
        D,
        """SELECT file_id, path, md5 FROM (SELECT file_id, regexp_replace(path, '/[0-9]+/', '/', 'g') AS path, md5 FROM d)
QUALIFY row_number() OVER (PARTITION BY path ORDER BY file_id DESC) = 1""",
    ),
    "stale_rows": _with(
        D,
        "SELECT file_id, path FROM c WHERE project_id = 'p0' AND path ILIKE '/library%' AND path NOT IN (SELECT path FROM l)",
    ),
    "cascade_delete": _with(
        D + "," + PROJECTS,
        """SELECT 'projects' AS name, count(*) AS rows FROM pr WHERE project_id <> '1' UNION ALL
SELECT 'roots', count(*) FROM rt WHERE project_id <> '1' UNION ALL SELECT 'files', count(*) FROM c WHERE project_id <> 'p1'""",
    ),
    "project_files": _with(
        D,
        """SELECT file_id, taken_at, row_number() OVER (ORDER BY taken_at NULLS FIRST, path) - 1 AS position
FROM c WHERE project_id = 'p2'""",
    ),
    "hash_files": _with(M, "SELECT file_id, phash FROM m WHERE owner % 3 = 1 AND owner % 7 <> 0 AND path ILIKE '/LIBRARY/0%'"),
    "vector_cache_lookup": _with(
        M,
        """SELECT file_id, phash >= 0 AS missing, CASE WHEN phash < 0 THEN round(vector[1], 6) END AS "first" FROM m""",
    ),
    "project_list": _with(
        PROJECTS, "SELECT project_id, name, row_number() OVER (ORDER BY created DESC, project_id) - 1 AS position FROM pr"
    ),
    "project_detail": _with(
        PROJECTS,
        """SELECT pr.project_id, count(root_id)::INTEGER AS n_roots, coalesce(string_agg(path, ';' ORDER BY rt.created, root_id), '') AS root_paths
FROM pr LEFT JOIN rt ON rt.project_id = pr.project_id GROUP BY 1""",
    ),
    "root_registration": _with(
        PROJECTS,
        """SELECT project_id, path, strftime(min(created), '%Y-%m-%d') AS created FROM rt
WHERE (project_id, path) NOT IN (SELECT (project_id, path) FROM rt WHERE o_orderstatus = 'F') GROUP BY 1, 2""",
    ),
    "target_md5_anti": _with(
        D,
        """SELECT file_id FROM c WHERE path NOT LIKE '/library/%' AND md5 NOT IN (SELECT md5 FROM c WHERE path LIKE '/library/%')""",
    ),
    "existing_sources": _with(D, "SELECT file_id FROM c WHERE path IN (SELECT path FROM l)"),
    "group_write": _with(
        D,
        """, og AS (SELECT file_id, project_id, lpad(CAST(min(file_id) OVER (PARTITION BY md5) AS VARCHAR), 12, '0') AS group_id,
 count(*) OVER (PARTITION BY md5) AS n FROM c)
SELECT project_id, CAST(file_id AS VARCHAR) AS file_id, group_id FROM og WHERE n >= 2 AND (project_id = 'p0' OR project_id = 'p1' AND file_id % 2 = 0)""",
    ),
    "content_claims": _with(
        D, "SELECT md5, path AS claim_path FROM c QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY taken_at NULLS FIRST, path) = 1"
    ),
    "destination_conflicts": _with(
        D,
        """SELECT path, CASE WHEN row_number() OVER (PARTITION BY file_name ORDER BY taken_at NULLS FIRST, path) = 1
    AND file_name NOT IN (SELECT file_name FROM c WHERE length(path) % 2 = 0) THEN concat('/library/in/', file_name)
  ELSE concat('/library/in/', regexp_replace(file_name, '\\.([^.]*)$', concat('_', substr(md5(path), 1, 6), '.\\1'))) END AS dest_path FROM c""",
    ),
    "organize_plan": _with(PLAN, "SELECT * FROM pl"),
    "organize_summary": _with(
        PLAN, "SELECT count(*) AS total, count(*) FILTER (status = 'ready') AS success, count(*) FILTER (status <> 'ready') AS skipped FROM pl"
    ),
    "organize_skip_reasons": _with(PLAN, "SELECT skip_reason, count(*) AS files FROM pl WHERE skip_reason IS NOT NULL GROUP BY 1"),
    "group_listing": _with(
        D + "," + GROUPS, "SELECT group_id, file_id, file_size, group_size, position = 0 AS recommended, position FROM g"
    ),
    "recommended_keeper": _with(D + "," + GROUPS, "SELECT group_id, file_id FROM g WHERE position = 0"),
    "folder_breakdown": _with(
        D + "," + GROUPS
        + """, f AS (SELECT group_id, regexp_replace(path, '/[^/]*$', '') AS f FROM g),
b AS (SELECT group_id, CASE WHEN NOT starts_with(f, '/library') THEN f ELSE regexp_replace(substr(f, 9), '^/', '') END AS folder, count(*) AS files FROM f GROUP BY 1, 2)""",
        """SELECT group_id, folder, files, count(*) OVER (PARTITION BY group_id) AS folders,
  count(*) OVER (PARTITION BY group_id) > 1 AS multi_folder FROM b""",
    ),
    "decisions": _with(DECISIONS, "SELECT * FROM de"),
    "delete_list": _with(DECISIONS, "SELECT group_id, file_id, file_size FROM de WHERE NOT keep"),
    "reclaimable": _with(DECISIONS, "SELECT count(*) AS files, coalesce(sum(file_size), 0)::BIGINT AS bytes FROM de WHERE NOT keep"),
}
ORACLES |= file_queries.ORACLES
