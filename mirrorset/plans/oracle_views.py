"""The same views as plain SQL text, used as CTE prefixes of the check queries."""

from __future__ import annotations

CATALOG = """catalog AS (
 SELECT doc_id AS file_id,
  '/lib/'||source||'/'||lang||'/f'||doc_id||CASE WHEN doc_id % 5 = 0 THEN '.jpg'
   WHEN doc_id % 7 = 0 THEN '.MKV' ELSE '.mp4' END AS path,
  '/lib/'||source||'/'||lang AS folder, doc_id % 5 = 0 AS is_image, n_chars * 1000 AS size,
  CASE WHEN doc_id % 5 = 0 THEN 0::DOUBLE ELSE (n_chars // 10)::DOUBLE END AS duration_s,
  (320 + doc_id % 7 * 160)::INT AS width, (240 + doc_id % 6 * 120)::INT AS height,
  n_chars * 37 % 9000 * 1000 + doc_id % 1000 AS bit_rate,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id::INT) AS created,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id + doc_id % 48)::INT) AS modified,
  (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 97 = 0 THEN 2 ELSE 0 END
   + CASE WHEN doc_id % 89 = 0 THEN 4 ELSE 0 END + CASE WHEN doc_id % 83 = 0 THEN 8 ELSE 0 END
   + CASE WHEN doc_id % 79 = 0 THEN 16 ELSE 0 END + CASE WHEN doc_id % 11 = 0 THEN 32 ELSE 0 END
   + CASE WHEN doc_id % 53 = 0 THEN 64 ELSE 0 END + CASE WHEN doc_id % 47 = 0 THEN 128 ELSE 0 END
   + CASE WHEN doc_id % 61 = 0 THEN 256 ELSE 0 END + 512)::INT AS flags,
  substr(md5(text), 1, 16) AS os_hash, 1::BIGINT AS dev,
  ('0x'||substr(md5(text), 1, 8))::UBIGINT::BIGINT * 2 + doc_id % 2 AS inode
 FROM documents)"""


def blocks(source: str = "documents", name: str = "blocks") -> str:
    key = "doc_id" if source == "documents" else "item_id"
    return f"""{name}_tok AS (
 SELECT {key} AS file_id, string_split_regex(trim(text, ' '), '[ \\t\\n\\r\\f]+') AS ws FROM {source}),
{name}_w AS (SELECT file_id, len(ws) AS n, generate_subscripts(ws, 1) - 1 AS idx, unnest(ws) AS w
 FROM {name}_tok),
{name} AS (SELECT file_id, n, idx, ('0x'||substr(md5(w), 1, 8))::UBIGINT::BIGINT AS blk FROM {name}_w)"""


def phash_of(frames: str, out: str, keys: str = "file_id, pos_idx") -> str:
    """Adds the median-rule hash to a relation (keys, gray)."""
    return f"""{out} AS (
 SELECT {keys}, gray,
  (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS phash
 FROM (SELECT {keys}, gray, list_sum(list_transform(range(64),
   lambda i: CASE WHEN gray[i + 1] * 2 > s[32] + s[33] THEN 2::HUGEINT ** i::INT ELSE 0 END))::HUGEINT AS h
  FROM (SELECT {keys}, gray, list_sort(gray) AS s FROM {frames})))"""


def frames_doc(k: int = 1) -> str:
    return blocks() + f""",
bins AS (SELECT file_id, (idx * {k} // n)::INT AS pos_idx, (blk % 64)::INT AS b, count(*) AS c
 FROM blocks GROUP BY ALL),
tops AS (SELECT file_id, pos_idx, max(c) AS m FROM bins GROUP BY ALL),
px AS (SELECT t.file_id, t.pos_idx, i.i, coalesce(255 * c // m, 0)::INT AS g
 FROM tops t CROSS JOIN (SELECT unnest(range(64))::INT AS i) i
 LEFT JOIN bins b ON b.file_id = t.file_id AND b.pos_idx = t.pos_idx AND b.b = i.i),
gray_frames AS (SELECT file_id, pos_idx, list(g ORDER BY i) AS gray FROM px GROUP BY ALL),
frames AS (
 SELECT file_id, pos_idx, gray,
  (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS phash
 FROM (SELECT p.file_id, p.pos_idx, any_value(f.gray) AS gray,
   sum(CASE WHEN p.g * 2 > f.s[32] + f.s[33] THEN (1::HUGEINT << p.i) ELSE 0::HUGEINT END) AS h
  FROM px p JOIN (SELECT file_id, pos_idx, gray, list_sort(gray) AS s FROM gray_frames) f
   ON p.file_id = f.file_id AND p.pos_idx = f.pos_idx GROUP BY ALL))"""


def features_doc(k: int = 1) -> str:
    return CATALOG + ",\n" + frames_doc(k) + f""",
features AS (SELECT c.file_id, c.is_image, c.duration_s, c.folder, c.size, c.dev, c.inode, c.path,
  f.gray, f.phashes
 FROM catalog c JOIN (SELECT file_id, flatten(list(gray ORDER BY pos_idx)) AS gray,
   list(phash ORDER BY pos_idx) AS phashes FROM frames GROUP BY file_id HAVING count(*) = {k}) f
 USING (file_id))"""


FRAMES_VEC = """vec_px AS (
 SELECT vec_id, c AS copy, i, greatest(0, least(255, floor(embedding[i + 1]::DOUBLE * 256)::INT + 128)) AS g0
 FROM embeddings, (SELECT unnest(range(3)) AS c), (SELECT unnest(range(64))::INT AS i)),
vec_noisy AS (SELECT vec_id, copy, i, CASE WHEN copy = 0 THEN g0 ELSE
  greatest(0, least(255, g0 + ((vec_id * 7 + i * 13 + copy * 3) % 5 - 2)::INT)) END AS g FROM vec_px),
vec_gray AS (SELECT vec_id * 3 + copy AS file_id, vec_id, copy, list(g ORDER BY i) AS gray
 FROM vec_noisy GROUP BY ALL),
frames_vec AS (SELECT f.file_id, f.vec_id, f.copy, (60 + f.vec_id % 50 * 20)::DOUBLE AS duration_s, f.gray,
  (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS phash
 FROM vec_gray f JOIN (
  SELECT p.vec_id * 3 + p.copy AS file_id,
   sum(CASE WHEN p.g * 2 > s.s[32] + s.s[33] THEN (1::HUGEINT << p.i) ELSE 0::HUGEINT END) AS h
  FROM vec_noisy p JOIN (SELECT file_id, list_sort(gray) AS s FROM vec_gray) s
   ON s.file_id = p.vec_id * 3 + p.copy GROUP BY ALL) h ON h.file_id = f.file_id)"""

EMB = """emb AS (SELECT vec_id * 3 + c AS file_id, vec_id, c AS copy, (60 + vec_id % 50 * 20)::DOUBLE AS duration_s,
  list(CASE WHEN c = 0 THEN q0 ELSE greatest(-127, least(127, q0 + (vec_id * 5 + i * 11 + c) % 3 - 1)) END
   ORDER BY i) AS q
 FROM (SELECT vec_id, c, i,
   greatest(-127, least(127, round_even((embedding[i + 1] * 127::FLOAT)::DOUBLE, 0)))::BIGINT AS q0
  FROM embeddings, (SELECT unnest(range(3)) AS c), (SELECT unnest(range(64))::INT AS i))
 GROUP BY vec_id, c)"""

ITEMS = """items AS (
 SELECT l_orderkey AS group_id, (l_partkey * 10000000 + l_suppkey * 10 + l_linenumber) * 5000
   + (l_shipdate::DATE - DATE '1970-01-01') % 5000 AS item_id,
  '/lib/s'||(l_suppkey % 50)||'/o'||l_orderkey||'_'||l_partkey||'_'||l_suppkey||'_'||l_linenumber||
   CASE WHEN l_orderkey % 5 = 0 THEN '.png' ELSE '.mp4' END AS path,
  '/lib/s'||(l_suppkey % 50) AS folder, l_orderkey % 5 = 0 AS is_image,
  round(l_extendedprice * 100)::BIGINT AS size,
  CASE WHEN l_orderkey % 5 = 0 THEN 0::DOUBLE ELSE l_quantity * 60 + l_linenumber END AS duration_s,
  (320 * (1 + l_partkey % 6))||'x'||(180 * (1 + l_partkey % 6)) AS frame_size,
  (500 * (1 + l_partkey % 6))::INT AS frame_size_int,
  CASE l_suppkey % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' ELSE 'av1' END AS format,
  CASE l_partkey % 11 WHEN 0 THEN 'HDR10' WHEN 1 THEN 'HLG' WHEN 2 THEN 'Dolby Vision'
   WHEN 3 THEN 'HDR10+' ELSE '' END AS hdr_format,
  CASE WHEN l_orderkey % 5 = 0 THEN 0::DOUBLE ELSE (24 + 6 * (l_suppkey % 4))::DOUBLE END AS fps,
  CASE WHEN l_orderkey % 5 = 0 THEN 0::BIGINT ELSE l_partkey * 7 % 9000 + 100 END AS bitrate_kbs,
  CASE WHEN l_suppkey % 2 = 0 THEN 'aac' ELSE 'ac3' END AS audio_format,
  CASE WHEN l_suppkey % 2 = 0 THEN 'stereo' ELSE '5.1' END AS audio_channel,
  (CASE WHEN l_suppkey % 3 = 0 THEN 44100 ELSE 48000 END)::INT AS audio_sample_rate,
  64 * (1 + l_suppkey % 5) AS audio_bitrate_kbs,
  (90000 + round(l_discount * 100)::BIGINT * 1000 - round(l_tax * 100)::BIGINT * 37) / 1000::DOUBLE AS similarity,
  l_shipdate - to_days(l_linenumber) AS created,
  CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE l_shipdate END AS modified,
  (CASE WHEN l_suppkey % 13 = 0 THEN 2 ELSE 0 END + CASE WHEN l_suppkey % 17 = 0 THEN 4 ELSE 0 END
   + CASE WHEN l_partkey % 4 = 0 THEN 8 ELSE 0 END + CASE WHEN l_partkey % 6 = 0 THEN 16 ELSE 0 END)::INT AS flags,
  CASE WHEN l_suppkey % 13 = 0 THEN l_linenumber * 15::DOUBLE ELSE 0::DOUBLE END AS offset_s,
  false AS is_reference, l_returnflag = 'R' AS checked, l_partkey % 10 <> 0 AS present,
  l_suppkey % 7 <> 0 AS root_ready, l_suppkey % 31 AS dev, l_partkey % 40 AS inode
 FROM lineitem)"""

FINGERPRINTS = blocks("documents", "src") + ",\n" + blocks("benchmark", "clp")


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"
