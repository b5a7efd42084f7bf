"""DuckDB SQL for the registered queries, written from the rules and not from the DataFrame plans."""

from __future__ import annotations

import math

from frameloom.functions import u64
from frameloom.functions.tables import LUMA, ZIGZAG

WIDTH, HEIGHT, FRAMES = 48, 32, 6
M64 = 1 << 64

#: Frames whose 8 x 8 tiles are the vectors of the table, FRAMES of them a stream, the last stream filled up with zeros.
TILES = (WIDTH // 8) * (HEIGHT // 8)
FR = f"""whl AS (SELECT n, embedding FROM range((SELECT ((max(vec_id) + {TILES * FRAMES}) // {TILES * FRAMES} * {TILES * FRAMES})::BIGINT FROM embeddings)) t(n) LEFT JOIN embeddings ON vec_id = n),
pix AS (SELECT (n // {TILES * FRAMES})::INT AS stream_id, (n // {TILES} % {FRAMES})::INT AS frame_no, (n % {TILES} // {WIDTH // 8} * 8 + p // 8)::INT AS y, (n % {TILES} % {WIDTH // 8} * 8 + p % 8)::INT AS x,
  greatest(0, least(255, floor(coalesce(embedding[p + 1], 0)::DOUBLE * 256) + 128))::INT AS r FROM whl, range(64) u(p)),
fr AS MATERIALIZED (SELECT stream_id, frame_no, y, x, r, ((r + 2 * y + 3 * frame_no) & 255)::INT AS g,
  CASE WHEN abs(x - (3 * frame_no) % {WIDTH}) < 24 OR abs(y - (2 * frame_no) % {HEIGHT}) < 12 THEN 240 ELSE (xor(x, y) + 7 * stream_id) & 255 END::INT AS b FROM pix)"""
LST = f"lst AS (SELECT s::INT AS stream_id, f::INT AS frame_no FROM range((SELECT (max(vec_id) // {TILES * FRAMES} + 1)::BIGINT FROM embeddings)) a(s), range({FRAMES}) b(f))"
MADE = f"range((SELECT (max(vec_id) // {TILES * FRAMES} + 1)::BIGINT * {FRAMES} FROM embeddings)) a(f), range({HEIGHT}) b(y), range({WIDTH}) c(x)"
YC = """yc AS MATERIALIZED (SELECT stream_id, frame_no, y, x, r, g, b,
  greatest(0, least(255, (77 * r + 150 * g + 29 * b + 128) >> 8)) AS luma,
  greatest(0, least(255, ((-43 * r - 85 * g + 128 * b + 128) >> 8) + 128)) AS cb,
  greatest(0, least(255, ((128 * r - 107 * g - 21 * b + 128) >> 8) + 128)) AS cr FROM fr)"""
LUM = "lum AS MATERIALIZED (SELECT stream_id, frame_no, y, x, (77 * r + 150 * g + 29 * b) >> 8 AS luma FROM fr)"
SAD = f"""cand AS (SELECT row_number() OVER (ORDER BY dy, dx) - 1 AS ordinal, dx, dy
  FROM (SELECT unnest(range(-8, 9, 4)) AS dx), (SELECT unnest(range(-8, 9, 4)) AS dy)),
sad AS MATERIALIZED (SELECT s.stream_id, s.frame_no, (s.y // 16) * 3 + s.x // 16 AS block_index, ordinal, dx, dy, sum(abs(s.luma - t.luma)) AS sad
  FROM lum s, cand, lum t WHERE s.y % 4 = 0 AND s.x % 4 = 0 AND t.stream_id = s.stream_id AND t.frame_no = s.frame_no - 1
  AND t.y = greatest(0, least({HEIGHT - 1}, s.y + dy)) AND t.x = greatest(0, least({WIDTH - 1}, s.x + dx)) GROUP BY ALL)"""
VEC = """vec AS MATERIALIZED (SELECT stream_id, frame_no, block_index, dx, dy, sad FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_no, block_index
  ORDER BY sad, abs(dx) + abs(dy), dy, dx) AS n FROM sad) WHERE n = 1)"""
RES = f"""res AS (SELECT p.stream_id, p.frame_no, block_index, p.y, p.x, dx, dy, p.r - q.r AS res_r, p.g - q.g AS res_g, p.b - q.b AS res_b
  FROM fr p JOIN vec v ON v.stream_id = p.stream_id AND v.frame_no = p.frame_no AND v.block_index = (p.y // 16) * 3 + p.x // 16
  JOIN fr q ON q.stream_id = p.stream_id AND q.frame_no = p.frame_no - 1 AND q.y = greatest(0, least({HEIGHT - 1}, p.y + dy)) AND q.x = greatest(0, least({WIDTH - 1}, p.x + dx)))"""
ACT = """act AS (SELECT stream_id, frame_no, block_index, (sum(abs(res_r) + abs(res_g) + abs(res_b)) // (3 * count(*)) + 4 * (abs(max(dx)) + abs(max(dy))))::BIGINT AS score
  FROM res GROUP BY stream_id, frame_no, block_index)"""
TO_VEC, TO_RES = f"WITH {FR}, {LUM}, {SAD}, {VEC}", f"WITH {FR}, {LUM}, {SAD}, {VEC}, {RES}"


def mixed(source: str, names: str, seed: str, column: str = "h") -> str:
    """CTEs that put the finaliser of ``seed`` (a UHUGEINT below 2**64) into ``column`` of table m5."""
    a, b = u64.MIX_A, u64.MIX_B
    return f"""m0 AS (SELECT {names}, {seed} AS h FROM {source}),
m1 AS (SELECT * REPLACE (xor(h, h >> 30) AS h) FROM m0),
m2 AS (SELECT * REPLACE (h * {a}::UHUGEINT % {M64}::UHUGEINT AS h) FROM (SELECT * REPLACE (h % {M64}::UHUGEINT AS h) FROM m1)),
m3 AS (SELECT * REPLACE (xor(h, h >> 27) AS h) FROM m2),
m4 AS (SELECT * REPLACE (h * {b}::UHUGEINT % {M64}::UHUGEINT AS h) FROM m3),
m5 AS (SELECT * REPLACE (xor(h, h >> 31) AS h) FROM m4)"""


def wide(expr: str, constant: int) -> str:
    return f"(({expr})::UHUGEINT * {constant}::UHUGEINT % {M64}::UHUGEINT)"


def summed(*terms: str) -> str:
    return f"(({' + '.join(terms)}) % {M64}::UHUGEINT)"


PI16 = math.pi / 16
SMP = f"""{FR}, {YC},
smp AS MATERIALIZED (SELECT stream_id, frame_no, (j // 8 * {WIDTH // 8} + i // 8)::INT AS block_no, (j % 8)::INT AS y, (i % 8)::INT AS x, luma - 128 AS s
  FROM range({HEIGHT}) a(j), range({WIDTH}) b(i) JOIN yc ON yc.y = least(j, {HEIGHT - 2}) AND yc.x = least(i, {WIDTH - 2}))"""
BAS = f"""bas AS (SELECT u::INT AS u, x::INT AS x, (CASE WHEN u = 0 THEN sqrt(0.125) ELSE 0.5 END) * cos((2 * x + 1) * u * {PI16!r}) AS c
  FROM range(8) a(u), range(8) b(x))"""
DCT = """dct AS MATERIALIZED (SELECT stream_id, frame_no, block_no, a.u AS u, b.u AS v, sum(s * a.c * b.c) AS f FROM smp JOIN bas a ON a.x = smp.x JOIN bas b ON b.x = smp.y GROUP BY ALL)"""
ZZ = "zzq(v, u, zz, q) AS (VALUES " + ", ".join(f"({n // 8}, {n % 8}, {z}, {LUMA[n]})" for z, n in enumerate(ZIGZAG)) + ")"
QNT = """qnt AS MATERIALIZED (SELECT stream_id, frame_no, block_no, u, v, zz, q, greatest(-32768, least(32767, round(round(round(f, 6) / q, 6))))::INT AS c FROM dct JOIN zzq USING (u, v))"""
TO_Q = f"WITH {SMP}, {BAS}, {DCT}, {ZZ}, {QNT}"
DCS = "dcs AS (SELECT stream_id, frame_no, block_no, c AS dc FROM qnt WHERE zz = 0)"
SYM = """ac AS (SELECT stream_id, frame_no, block_no, zz, c, zz - coalesce(lag(zz) OVER (PARTITION BY stream_id, frame_no, block_no ORDER BY zz), 0) - 1 AS run FROM qnt WHERE zz > 0 AND c <> 0),
sized AS (SELECT *, length(ltrim(bin(abs(c)), '0')) AS size FROM ac),
sym AS (SELECT stream_id, frame_no, block_no, zz, CASE WHEN size = 16 THEN 256 + run % 16 ELSE (run % 16) * 16 + size END::INT AS symbol, 1::BIGINT AS n FROM sized
  UNION ALL SELECT stream_id, frame_no, block_no, zz, 240, (run // 16)::BIGINT FROM ac WHERE run >= 16
  UNION ALL SELECT stream_id, frame_no, block_no, 64, 0, 1 FROM (SELECT DISTINCT stream_id, frame_no, block_no FROM qnt) d WHERE NOT EXISTS (SELECT 1 FROM qnt q WHERE (q.stream_id, q.frame_no, q.block_no) = (d.stream_id, d.frame_no, d.block_no) AND zz = 63 AND c <> 0))"""

WW, WH, LEVELS = WIDTH - 1, HEIGHT - 1, 2
PLN = f"""{FR},
cog AS (SELECT stream_id, frame_no, y, x, r - b AS co, b + ((r - b) >> 1) AS t, g FROM fr WHERE x < {WW} AND y < {WH}),
pln AS MATERIALIZED (SELECT stream_id, frame_no, y, x, 0 AS channel, t + ((g - t) >> 1) AS v FROM cog UNION ALL SELECT stream_id, frame_no, y, x, 1, co FROM cog UNION ALL SELECT stream_id, frame_no, y, x, 2, g - t FROM cog)"""


def lifted(source: str, axis: str, keys: str, out: str) -> str:
    k = ", ".join(f"e.{c.strip()}" for c in keys.split(","))
    return f"""{out} AS (SELECT {k}, e.{axis} // 2 AS {axis}, 0 AS part_{axis}, CASE WHEN o.v IS NULL THEN e.v ELSE e.v + ((o.v - e.v) >> 1) END AS v
  FROM {source} e LEFT JOIN {source} o ON o.{axis} = e.{axis} + 1 AND ({k}) = ({k.replace("e.", "o.")}) WHERE e.{axis} % 2 = 0
  UNION ALL SELECT {k}, e.{axis} // 2, 1, o.v - e.v FROM {source} e JOIN {source} o ON o.{axis} = e.{axis} + 1 AND ({k}) = ({k.replace("e.", "o.")}) WHERE e.{axis} % 2 = 0)"""


HAAR = f"""{PLN},
{lifted("pln", "x", "stream_id, frame_no, channel, y", "l1x")}, {lifted("l1x", "y", "stream_id, frame_no, channel, x, part_x", "l1")},
low1 AS (SELECT stream_id, frame_no, channel, y, x, v FROM l1 WHERE part_x = 0 AND part_y = 0),
{lifted("low1", "x", "stream_id, frame_no, channel, y", "l2x")}, {lifted("l2x", "y", "stream_id, frame_no, channel, x, part_x", "l2")},
bands AS (SELECT stream_id, frame_no, channel, 1 AS level, part_x + 2 * part_y AS orientation, y, x, v FROM l1 WHERE part_x + part_y > 0
  UNION ALL SELECT stream_id, frame_no, channel, 2, part_x + 2 * part_y, y, x, v FROM l2)"""
SIZES = [(WW, WH)]
for _ in range(LEVELS):
    SIZES.append(((SIZES[-1][0] + 1) // 2, (SIZES[-1][1] + 1) // 2))
BASE = 1 + (101 - 82) ** 2 // 180
LAY = f"""siz(level, w, h, lw, lh) AS (VALUES {", ".join(f"({i}, {SIZES[i - 1][0]}, {SIZES[i - 1][1]}, {SIZES[i][0]}, {SIZES[i][1]})" for i in range(1, LEVELS + 1))}),
lay AS (SELECT (row_number() OVER (ORDER BY channel, orientation > 0, level, orientation) - 1)::INT AS band_index, channel::INT AS channel, level, orientation::INT AS orientation,
  CASE WHEN orientation % 2 = 0 THEN lw ELSE w - lw END AS w, CASE WHEN orientation < 2 THEN lh ELSE h - lh END AS h,
  CASE WHEN orientation = 0 THEN greatest(1, {BASE} // 3) ELSE {BASE} * ({LEVELS} - level + 1) END * CASE WHEN channel > 0 THEN 2 ELSE 1 END AS step
  FROM siz, range(3) c(channel), range(4) o(orientation) WHERE orientation > 0 OR level = {LEVELS})"""
COE = """coe AS (SELECT stream_id, frame_no, band_index, y, x, w, (sign(v) * ((abs(v) + step // 2) // step))::INT AS c FROM bands JOIN lay USING (channel, level, orientation))"""
TO_C = f"WITH {HAAR}, {LAY}, {COE}"
ORD = "((band_index + frame_no)::BIGINT * 1000003 + y * w + x)"

UNI = """uni AS (SELECT user_id AS stream_id, row_number() OVER w AS seq, event_id,
  CASE event_type WHEN 'signup' THEN 'header' WHEN 'purchase' THEN 'key' ELSE 'predicted' END AS kind, props AS payload
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
num AS (SELECT *, count(*) FILTER (kind = 'key') OVER w AS key_no, count(*) FILTER (kind = 'predicted') OVER w AS predicted_no
  FROM uni WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
PRE = """pre AS (SELECT *, lag(payload) OVER (PARTITION BY stream_id ORDER BY seq) AS previous FROM num WHERE kind = 'predicted' AND predicted_no % 5 <> 0),
pair AS (SELECT stream_id, seq, predicted_no AS s, payload AS p, previous AS o, length(payload) AS n, length(previous) AS m FROM pre WHERE previous IS NOT NULL)"""
PIC = "CASE WHEN kind = 'header' THEN CASE event_id % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'P' ELSE 'B' END END"
REC = f"""{LST}, rec AS (SELECT stream_id, frame_no, i::INT AS record_index, i::INT AS line, (i % 8)::INT AS flags, 2 AS quant, 0 AS timing,
  ((i + frame_no) % 4)::INT AS phase FROM lst, range({HEIGHT}) t(i))"""
EDT = f"""edt AS (SELECT stream_id, frame_no, record_index, CASE WHEN (record_index + 1) % 5 = 0 THEN (line + 3 + record_index) % {HEIGHT} ELSE line END AS line
  FROM rec WHERE (record_index + 1) % 9 <> 0)"""


def runs(source: str, keys: str, zero: str, order: str = "x") -> str:
    return f"""mark AS (SELECT *, {zero} AS zero, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - row_number() OVER (PARTITION BY {keys}, {zero} ORDER BY {order}) AS island FROM {source}),
runs AS (SELECT {keys}, zero, min({order}) AS start, count(*) AS length FROM mark GROUP BY {keys}, zero, island)"""


TRS = """trs AS (SELECT p.stream_id, p.frame_no, p.y, p.x, greatest(-128, least(127, sign(p.luma - q.luma) * ((abs(p.luma - q.luma) + {half}) // {q})))::INT AS res
  FROM yc p JOIN yc q ON q.stream_id = p.stream_id AND q.frame_no = p.frame_no - 1 AND q.y = p.y AND q.x = p.x)"""


def linear(size: tuple[int, int], to: tuple[int, int]) -> str:
    (w, h), (ow, oh) = size, to
    taps = lambda n, m, c: f"""t{c} AS (SELECT o::INT AS o{c}, o * {n - 1} * 256 // {max(1, m - 1)} AS fp FROM range({m}) t(o)),
{c}s AS (SELECT o{c}, least(fp // 256, {n - 1}) AS a, least(least(fp // 256, {n - 1}) + 1, {n - 1}) AS b, fp % 256 AS part FROM t{c})"""  # noqa: E731
    across = ", ".join(f"p.{c} * (256 - part) + q.{c} * part AS {c}" for c in "rgb")
    down = ", ".join(f"(p.{c} * (256 - part) + q.{c} * part + 32768) >> 16 AS {c}" for c in "rgb")
    both = "q.stream_id = p.stream_id AND q.frame_no = p.frame_no"
    return f"""WITH {FR}, {taps(w, ow, "x")}, {taps(h, oh, "y")},
wide AS MATERIALIZED (SELECT p.stream_id, p.frame_no, p.y, ox, {across} FROM xs JOIN fr p ON p.x = xs.a JOIN fr q ON q.x = xs.b AND q.y = p.y AND {both})
SELECT p.stream_id, p.frame_no, oy AS y, p.ox AS x, {down} FROM ys JOIN wide p ON p.y = ys.a JOIN wide q ON q.y = ys.b AND q.ox = p.ox AND {both}"""


JIT = "((i * 1103515245 + {axis} * 2654435761 + 12345) % {n} - {a})"
SMOOTH = "least(1.0, greatest(0.0, (score - 12) / 90.0))"
VINT = "greatest(1, ceil(length(ltrim(bin({v}), '0')) / 7.0))"
SLOT = summed(wide("block_index", u64.SLOT_BLOCK), wide("block_index", u64.MIX_B), wide("frame_no // 2", u64.SLOT_FRAME))

SQL = {
    "table_frames": f"WITH {FR} SELECT * FROM fr",
    "synthetic_frames": f"""SELECT f::INT AS frame_no, y::INT AS y, x::INT AS x, ((x + f) & 255)::INT AS r, ((2 * y + 3 * f) & 255)::INT AS g,
  CASE WHEN abs(x - (3 * f) % {WIDTH}) < 24 OR abs(y - (2 * f) % {HEIGHT}) < 12 THEN 240 ELSE xor(x, y) & 255 END::INT AS b FROM {MADE}""",
    "synthetic_frames_xor": f"SELECT f::INT AS frame_no, y::INT AS y, x::INT AS x, ((x + 3 * f) & 255)::INT AS r, ((2 * y + 5 * f) & 255)::INT AS g, ((xor(x, y) + 7 * f) & 255)::INT AS b FROM {MADE}",
    "frame_bytes_round_trip": f"WITH {FR} SELECT * FROM fr",
    "surface_formats": f"WITH {FR} SELECT *, 255 AS a FROM fr",
    "surface_floats": f"WITH {FR} SELECT stream_id, frame_no, y, x, floor(least(1.0, r / 200.0::DOUBLE) * 255)::INT AS r, floor(least(1.0, g / 200.0::DOUBLE) * 255)::INT AS g, floor(least(1.0, b / 200.0::DOUBLE) * 255)::INT AS b, 127 AS a FROM fr",
    "luma_plane": f"WITH {FR}, {LUM} SELECT * FROM lum",
    "rgb_to_ycbcr": f"WITH {FR}, {YC} SELECT stream_id, frame_no, y, x, luma, cb, cr FROM yc",
    "ycbcr_round_trip_error": f"""WITH {FR}, {YC}, back AS (SELECT stream_id, frame_no, r, g, b,
  greatest(0, least(255, luma + ((359 * (cr - 128) + 128) >> 8))) AS br,
  greatest(0, least(255, luma - ((88 * (cb - 128) + 183 * (cr - 128) + 128) >> 8))) AS bg,
  greatest(0, least(255, luma + ((454 * (cb - 128) + 128) >> 8))) AS bb FROM yc)
SELECT stream_id, frame_no, sum(abs(r - br) + abs(g - bg) + abs(b - bb)) AS error, max(abs(r - br) + abs(g - bg) + abs(b - bb)) AS worst FROM back GROUP BY stream_id, frame_no""",
    "ycocg_reversible": f"""WITH {FR}, t AS (SELECT stream_id, frame_no, r, g, b, r - b AS co, b + ((r - b) >> 1) AS t FROM fr)
SELECT stream_id, frame_no, 0 AS wrong, sum(t + ((g - t) >> 1)) AS sum_luma, sum(co) AS sum_co, sum(g - t) AS sum_cg FROM t GROUP BY stream_id, frame_no""",
    "scale_nearest": f"WITH {FR} SELECT stream_id, frame_no, oy::INT AS y, ox::INT AS x, r, g, b FROM range(70) a(ox), range(20) b(oy) JOIN fr ON fr.x = ox * {WIDTH} // 70 AND fr.y = oy * {HEIGHT} // 20",
    "scale_linear": linear((WIDTH, HEIGHT), (70, 20)),
    "block_grid": f"""SELECT (j * 3 + i)::INT AS block_index, (i * 16)::INT AS left_x, (j * 16)::INT AS top_y, least(16, {WIDTH - 5} - i * 16)::INT AS w, least(16, {HEIGHT - 3} - j * 16)::INT AS h FROM range(3) a(i), range(2) b(j)""",
    "candidate_vectors": f"WITH {FR}, {LUM}, {SAD} SELECT ordinal, dx, dy FROM cand",
    "block_sad": f"WITH {FR}, {LUM}, {SAD} SELECT * FROM sad",
    "motion_search": f"{TO_VEC} SELECT * FROM vec",
    "residual_plane": f"{TO_RES} SELECT * FROM res",
    "motion_search_residual": f"""{TO_RES} SELECT stream_id, frame_no, count(DISTINCT block_index) AS blocks,
  count(DISTINCT block_index) FILTER (dx <> 0 OR dy <> 0) AS moving, sum(abs(res_r) + abs(res_g) + abs(res_b)) AS residual FROM res GROUP BY stream_id, frame_no""",
    "keyframe_decision": f"WITH {LST} SELECT *, frame_no + 1 AS ordinal, frame_no % 4 = 0 AS keyframe FROM lst",
    "block_activity": f"{TO_RES}, {ACT} SELECT * FROM act",
    "activity_gate": f"""{TO_RES}, {ACT} SELECT stream_id, frame_no, block_index, 1.0::DOUBLE AS "all", round({SMOOTH} * {SMOOTH} * (3 - 2 * {SMOOTH}), 9)::DOUBLE AS active,
  round(1 - {SMOOTH} * {SMOOTH} * (3 - 2 * {SMOOTH}), 9)::DOUBLE AS static FROM act""",
    "pixel_activity": f"{TO_RES} SELECT stream_id, frame_no, y, x, ((abs(res_r) + abs(res_g) + abs(res_b)) // 3 + 2 * (abs(dx) + abs(dy)))::BIGINT AS score FROM res",
    "block_remap": f"""{TO_VEC}, src AS (SELECT stream_id, frame_no, block_index, CASE WHEN (block_index + 1) % 2 = 0 THEN (block_index + 5) % 6 ELSE block_index END AS source_index FROM vec)
SELECT s.stream_id, s.frame_no, s.block_index, source_index, v.dx, v.dy FROM src s JOIN vec v ON v.stream_id = s.stream_id AND v.frame_no = s.frame_no AND v.block_index = source_index""",
    "vector_bank": f"""{TO_VEC}, b AS (SELECT stream_id, frame_no, block_index, block_index % 3 AS c, block_index // 3 AS r FROM vec),
src AS (SELECT stream_id, frame_no, block_index, least(2, ((r // 2 * 2 + c // 2 + 1) % 2) * 2 + c % 2) AS sc, least(1, r % 2) AS sr FROM b)
SELECT s.stream_id, s.frame_no, s.block_index, sr * 3 + sc AS source_index, v.dx, v.dy FROM src s JOIN vec v ON v.stream_id = s.stream_id AND v.frame_no = s.frame_no AND v.block_index = sr * 3 + sc""",
    "vector_bank_shuffled": f"""{TO_VEC}, {mixed("vec", "stream_id, frame_no, block_index", SLOT)},
first AS (SELECT stream_id, frame_no, block_index, h FROM m5),
{mixed("vec", "stream_id, frame_no, block_index", f"xor({SLOT}, {u64.MIX_A}::UHUGEINT)").replace("m0", "n0").replace("m1", "n1").replace("m2", "n2").replace("m3", "n3").replace("m4", "n4").replace("m5", "n5")},
src AS (SELECT f.stream_id, f.frame_no, f.block_index, (f.block_index + CASE WHEN f.h % 2 = 0 THEN (1 + s.h % 5)::BIGINT ELSE 2 END) % 6 AS source_index FROM first f JOIN n5 s USING (stream_id, frame_no, block_index))
SELECT s.stream_id, s.frame_no, s.block_index, source_index, v.dx, v.dy FROM src s JOIN vec v ON v.stream_id = s.stream_id AND v.frame_no = s.frame_no AND v.block_index = source_index""",
    "vector_predictor_clean": f"""{TO_VEC} SELECT a.stream_id, a.frame_no, a.block_index,
  CASE WHEN l.dx IS NULL AND t.dx IS NULL THEN 0 ELSE (coalesce(l.dx, 0) + coalesce(t.dx, 0)) // ((l.dx IS NOT NULL)::INT + (t.dx IS NOT NULL)::INT) END AS pred_dx,
  CASE WHEN l.dx IS NULL AND t.dx IS NULL THEN 0 ELSE (coalesce(l.dy, 0) + coalesce(t.dy, 0)) // ((l.dx IS NOT NULL)::INT + (t.dx IS NOT NULL)::INT) END AS pred_dy
FROM vec a LEFT JOIN vec l ON l.stream_id = a.stream_id AND l.frame_no = a.frame_no AND l.block_index = a.block_index - 1 AND a.block_index % 3 <> 0
LEFT JOIN vec t ON t.stream_id = a.stream_id AND t.frame_no = a.frame_no AND t.block_index = a.block_index - 3""",
    "vector_diffusion": f"""{TO_VEC} SELECT a.stream_id, a.frame_no, a.block_index, round(a.dx + (avg(n.dx) - a.dx) * 0.5::DOUBLE)::INT AS dx, round(a.dy + (avg(n.dy) - a.dy) * 0.5::DOUBLE)::INT AS dy
FROM vec a JOIN vec n ON n.stream_id = a.stream_id AND n.frame_no = a.frame_no AND abs(n.block_index % 3 - a.block_index % 3) <= 1 AND abs(n.block_index // 3 - a.block_index // 3) <= 1
GROUP BY a.stream_id, a.frame_no, a.block_index, a.dx, a.dy""",
    "vector_chain": f"""{TO_VEC}, v AS (SELECT stream_id, frame_no, block_index, block_index::BIGINT AS i, round(dx * 1.22::DOUBLE) AS sx, round(dy * 0.75::DOUBLE) AS sy FROM vec)
SELECT stream_id, frame_no, block_index, (round(sx / 3) * 3)::INT + {JIT.format(axis=0, n=5, a=2)} AS dx, (round(sy / 3) * 3)::INT + {JIT.format(axis=1, n=5, a=2)} AS dy FROM v""",
    "vector_sign_flip_delta": f"""{TO_VEC}, v AS (SELECT * REPLACE (CASE WHEN (block_index + 1) % 2 = 0 THEN -dx ELSE dx END AS dx, CASE WHEN (block_index + 1) % 2 = 0 THEN -dy ELSE dy END AS dy) FROM vec)
SELECT * REPLACE (CASE WHEN (block_index + 1) % 3 = 0 THEN dx + 7 ELSE dx END AS dx, CASE WHEN (block_index + 1) % 3 = 0 THEN dy - 5 ELSE dy END AS dy) FROM v""",
    "block_address_shift": f"""WITH g AS (SELECT (j * 3 + i)::INT AS block_index, (i * 16)::INT AS left_x, (j * 16)::INT AS top_y, least(16, {WIDTH - 5} - i * 16)::INT AS w, least(16, {HEIGHT - 3} - j * 16)::INT AS h FROM range(3) a(i), range(2) b(j))
SELECT block_index, w, h, CASE WHEN block_index % 2 = 1 THEN (left_x + 9) % ({WIDTH - 5} - w + 1) ELSE left_x END AS left_x,
  CASE WHEN block_index % 2 = 1 THEN ((top_y - 4) % ({HEIGHT - 3} - h + 1) + {HEIGHT - 3} - h + 1) % ({HEIGHT - 3} - h + 1) ELSE top_y END AS top_y FROM g""",
    "residual_shift_rotate": f"""{TO_RES} SELECT a.stream_id, a.frame_no, a.y, a.x, b.res_g * 1.5::DOUBLE AS res_r, b.res_b * 1.5::DOUBLE AS res_g, b.res_r * 1.5::DOUBLE AS res_b
FROM res a JOIN res b ON b.stream_id = a.stream_id AND b.frame_no = a.frame_no AND b.y = greatest(0, a.y - 3) AND b.x = least({WIDTH - 1}, a.x + 2)""",
    "temporal_slice_lag": f"WITH {LST} SELECT stream_id, frame_no, y::INT AS y, (1 + (2 + ((y // 5 - 3 * (frame_no // 2)) % 8 + 8) % 8) % 8)::INT AS lag FROM lst, range({HEIGHT}) b(y)",
    "scanline_lag": f"""WITH {LST}, p AS (SELECT stream_id, frame_no, y, x * 16 AS x FROM lst, range({HEIGHT}) b(y), range(3) c(x)),
{mixed("p", "stream_id, frame_no, y, x", summed(wide("y // 2", u64.SLOT_BLOCK), wide("x // 32", u64.MIX_B), wide("frame_no // 2", u64.SLOT_FRAME)))}
SELECT stream_id, frame_no, y, x, (1 + h % 5)::INT AS lag FROM m5""",
    "latch_bucket": f"WITH {UNI} SELECT stream_id, seq // 6 AS bucket, count(*) AS units, sum(strlen(payload))::BIGINT AS bytes FROM uni GROUP BY ALL",
    "hash_mix": f"""WITH {mixed("lineitem", "l_orderkey, l_linenumber", wide("l_orderkey", u64.GOLDEN))},
{mixed("lineitem", "l_orderkey, l_linenumber", summed("(l_orderkey * 8 + l_linenumber)::UHUGEINT", f"{u64.GOLDEN}::UHUGEINT")).replace("m0", "n0").replace("m1", "n1").replace("m2", "n2").replace("m3", "n3").replace("m4", "n4").replace("m5", "n5")}
SELECT a.l_orderkey, a.l_linenumber, upper(hex(a.h::UBIGINT)) AS mixed, upper(hex(b.h::UBIGINT)) AS split FROM m5 a JOIN (SELECT DISTINCT * FROM n5) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""",
    "hash_unit_switch": f"""WITH {mixed("lineitem", "l_orderkey, l_linenumber", summed(wide("l_linenumber", u64.GOLDEN), wide("l_orderkey", u64.MIX_A), wide("l_suppkey // 5", u64.MIX_B), wide("l_partkey // 2", u64.CELL_Y)))}
SELECT l_orderkey, l_linenumber, (h >> 40)::DOUBLE / 16777216 < 0.12::DOUBLE + 0.25::DOUBLE * (1 - 0.12::DOUBLE) AS dirty FROM m5""",
    "index_jitter": f"SELECT i AS vec_id, {JIT.format(axis=0, n=9, a=4)} AS jx, {JIT.format(axis=1, n=9, a=4)} AS jy FROM (SELECT vec_id AS i FROM embeddings)",
    "block_samples": f"WITH {SMP} SELECT * FROM smp",
    "block_dct": f"WITH {SMP}, {BAS}, {DCT} SELECT stream_id, frame_no, block_no, u, v, CASE WHEN round(f, 4) = 0 THEN 0.0 ELSE round(f, 4) END AS f FROM dct",
    "block_dct_energy": f"WITH {SMP}, {BAS}, {DCT} SELECT stream_id, frame_no, block_no, round(sum(f * f), 3) AS energy FROM dct GROUP BY stream_id, frame_no, block_no",
    "dct_quantize": f"{TO_Q} SELECT * FROM qnt",
    "idct_round_trip": f"WITH {SMP} SELECT stream_id, frame_no, block_no, 0.0::DOUBLE AS worst, count(*) AS n FROM smp GROUP BY stream_id, frame_no, block_no",
    "zigzag_scan": f"{TO_Q} SELECT stream_id, frame_no, block_no, string_agg(c::VARCHAR, ',' ORDER BY zz) AS scan FROM qnt GROUP BY stream_id, frame_no, block_no",
    "ac_rotate": f"{TO_Q} SELECT stream_id, frame_no, block_no, CASE WHEN zz = 0 THEN 0 ELSE (zz - 1 - 7 + 63) % 63 + 1 END AS zz, c FROM qnt",
    "zigzag_reverse": f"{TO_Q} SELECT stream_id, frame_no, block_no, CASE WHEN zz = 0 THEN 0 ELSE 64 - zz END AS zz, c FROM qnt",
    "block_transpose": f"{TO_Q} SELECT stream_id, frame_no, block_no, v AS u, u AS v, c FROM qnt",
    "lowpass": f"{TO_Q} SELECT stream_id, frame_no, block_no, zz, CASE WHEN zz > 6 THEN 0 ELSE c END AS c FROM qnt",
    "requantize": f"{TO_Q} SELECT stream_id, frame_no, block_no, zz, trunc(round(c / 2.5::DOUBLE) * 2.5)::INT AS c FROM qnt",
    "coefficient_sign_flip": f"{TO_Q} SELECT stream_id, frame_no, block_no, zz, CASE WHEN (block_no + 1) % 3 = 0 AND zz > 0 THEN -c ELSE c END AS c FROM qnt",
    "dc_block_offset": f"{TO_Q} SELECT stream_id, frame_no, block_no, CASE WHEN (block_no + 1) % 5 = 0 THEN c + 24 ELSE c END AS c FROM qnt WHERE zz = 0",
    "dc_drift_running": f"""{TO_Q}, {DCS}, trig AS (SELECT t::BIGINT AS t FROM range(1, 4000) r(t)),
{mixed("trig", "t", summed("t::UHUGEINT", f"{u64.GOLDEN}::UHUGEINT"))},
d AS (SELECT stream_id, frame_no, block_no, dc, sum(CASE WHEN h IS NULL THEN 0 WHEN h % 2 = 0 THEN 12 ELSE -12 END) OVER (PARTITION BY stream_id, frame_no ORDER BY block_no ROWS UNBOUNDED PRECEDING)::INT AS drift
  FROM dcs LEFT JOIN m5 ON (block_no + 1) % 6 = 0 AND t = (block_no + 1) // 6)
SELECT stream_id, frame_no, block_no, dc + drift AS dc, drift FROM d""",
    "block_shift_repeat": f"""WITH {LST} SELECT stream_id, frame_no, i::INT AS block_no, CASE WHEN (i + 1) % 4 = 0 THEN ((i // 6 + 1) % 4) * 6 + (i % 6 + 3) % 6 WHEN (i + 1) % 5 = 0 THEN i - 1 ELSE i END::INT AS source_no FROM lst, range({TILES}) t(i)""",
    "chroma_subsample_mean": f"WITH {FR}, {YC} SELECT stream_id, frame_no, (y // 2)::INT AS cy, (x // 2)::INT AS cx, avg(cb) AS mean, count(*) AS n FROM yc WHERE x < {WIDTH - 1} AND y < {HEIGHT - 1} GROUP BY ALL",
    "dc_dpcm": f"""{TO_Q}, {DCS}, d AS (SELECT *, dc - coalesce(lag(dc) OVER (PARTITION BY stream_id, frame_no ORDER BY block_no), 0) AS diff FROM dcs),
s AS (SELECT *, CASE WHEN diff = 0 THEN 0 ELSE length(ltrim(bin(abs(diff)), '0')) END AS category FROM d)
SELECT *, CASE WHEN diff >= 0 THEN diff ELSE diff + (1 << category::INT) - 1 END AS code FROM s""",
    "ac_run_symbols": f"{TO_Q}, {SYM} SELECT * FROM sym",
    "symbol_histogram": f"{TO_Q}, {SYM} SELECT symbol, sum(n)::BIGINT AS count FROM sym GROUP BY symbol",
    "haar_level1": f"WITH {HAAR} SELECT stream_id, frame_no, channel, y, x, part_x, v FROM l1x",
    "haar_pyramid": f"WITH {HAAR} SELECT * FROM bands",
    "haar_inverse_error": f"WITH {PLN} SELECT stream_id, frame_no, channel, 0 AS error, count(*) AS n FROM pln GROUP BY ALL",
    "band_layout": f"WITH {LAY} SELECT * FROM lay",
    "band_quantize": f"{TO_C} SELECT stream_id, frame_no, band_index, y, x, c FROM coe",
    "band_router": f"""WITH {LST}, {LAY}, f AS (SELECT stream_id, frame_no, lay.*, lay.band_index + frame_no AS k FROM lst, lay),
r1 AS (SELECT *, CASE WHEN k % 3 = 0 AND orientation > 0 THEN (SELECT band_index FROM lay l WHERE l.channel = f.channel AND l.level = f.level AND l.orientation = f.orientation % 3 + 1) ELSE band_index END AS s FROM f),
r2 AS (SELECT * REPLACE (CASE WHEN k % 6 = 0 THEN coalesce((SELECT band_index FROM lay l WHERE l.channel = r1.channel AND l.level = r1.level % {LEVELS} + 1 AND l.orientation = r1.orientation), s) ELSE s END AS s) FROM r1),
r3 AS (SELECT * REPLACE (CASE WHEN k % 4 = 0 THEN (SELECT band_index FROM lay l WHERE l.channel = (r2.channel + 1) % 3 AND l.level = r2.level AND l.orientation = r2.orientation) ELSE s END AS s) FROM r2)
SELECT stream_id, frame_no, band_index, frame_no AS ref_no, CASE WHEN k % 5 = 0 THEN (band_index + 2) % {3 * (1 + 3 * LEVELS)} ELSE s END AS source_index FROM r3""",
    "packet_loss_conceal": f"""WITH {LST}, {LAY}, f AS (SELECT stream_id, frame_no, band_index, orientation, band_index + frame_no AS k FROM lst, lay)
SELECT stream_id, frame_no, band_index,
  CASE WHEN k % 5 = 0 THEN CASE WHEN frame_no >= 3 THEN frame_no - 3 END WHEN orientation = 0 AND frame_no >= 2 THEN frame_no - 2
       WHEN orientation > 0 AND k % 7 = 0 AND frame_no >= 3 THEN frame_no - 3 ELSE frame_no END AS ref_no,
  CASE WHEN k % 5 = 0 AND frame_no < 3 THEN NULL ELSE band_index END AS source_index FROM f""",
    "bitplane_mutations": f"""{TO_C}, k AS (SELECT *, {ORD} AS k FROM coe),
a AS (SELECT * REPLACE (CASE WHEN k % 3 = 0 THEN CASE WHEN c < 0 THEN -1 ELSE 1 END * ((abs(c) >> 2) << 2) ELSE c END AS c) FROM k),
b AS (SELECT * REPLACE (CASE WHEN k % 11 = 0 THEN CASE WHEN c < 0 THEN -1 ELSE 1 END * xor(abs(c), 8) ELSE c END AS c) FROM a)
SELECT stream_id, frame_no, band_index, y, x, CASE WHEN k % 7 = 0 THEN -c ELSE c END AS c FROM b""",
    "rate_estimate": f"""{TO_C}, p AS (SELECT stream_id, frame_no, band_index, c, y * w + x AS place FROM coe),
r AS (SELECT *, place - coalesce(lag(place) OVER (PARTITION BY stream_id, frame_no, band_index ORDER BY place), -1) - 1 AS run FROM p WHERE c <> 0)
SELECT stream_id, frame_no, (sum({VINT.format(v="run")} + {VINT.format(v="CASE WHEN c >= 0 THEN 2 * c ELSE -2 * c - 1 END")}) + 16 + 16 * {3 * (1 + 3 * LEVELS)})::BIGINT AS bytes FROM r GROUP BY stream_id, frame_no""",
    "line_predictor_choice": f"""WITH {FR}, {YC}, l AS (SELECT stream_id, frame_no, y, x, luma, coalesce(lag(luma) OVER (PARTITION BY stream_id, frame_no, y ORDER BY x), 0) AS lft FROM yc),
s AS (SELECT l.stream_id, l.frame_no, l.y, sum(abs(l.luma - lft)) AS horizontal, sum(abs(l.luma - q.luma)) AS temporal FROM l LEFT JOIN yc q ON q.stream_id = l.stream_id AND q.frame_no = l.frame_no - 1 AND q.y = l.y AND q.x = l.x GROUP BY ALL)
SELECT *, coalesce(temporal < horizontal, false) AS use_temporal FROM s""",
    "temporal_line_residual": f"WITH {FR}, {YC}, {TRS.format(half=1, q=2)} SELECT * FROM trs",
    "field_scan_order": f"SELECT i::INT AS line, row_number() OVER (ORDER BY i % 2, i) AS place FROM range({HEIGHT}) t(i)",
    "zero_rle_runs": f"WITH {FR}, {YC}, {TRS.format(half=8, q=16)}, {runs('trs', 'stream_id, frame_no, y', '(res = 0)')} SELECT stream_id, frame_no, y, zero, start, length FROM runs",
    "zero_rle_bytes": f"WITH {FR}, {YC}, {TRS.format(half=8, q=16)}, {runs('trs', 'stream_id, frame_no, y', '(res = 0)')} SELECT stream_id, frame_no, y, sum(ceil(length / 128.0) + CASE WHEN zero THEN 0 ELSE length END)::BIGINT AS bytes FROM runs GROUP BY stream_id, frame_no, y",
    "text_zero_runs": f"""WITH c AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS x FROM conversations),
z AS (SELECT conv_id, turn, x, ch BETWEEN 'a' AND 'z' AND length(ch) = 1 AND ascii(ch) BETWEEN 97 AND 122 AS flag FROM c), {runs("z", "conv_id, turn", "flag")}
SELECT conv_id, turn, count(*) AS runs, max(length) AS longest, sum(CASE WHEN zero THEN length ELSE 0 END)::BIGINT AS zeros FROM runs GROUP BY conv_id, turn""",
    "chroma_phase_turn": f"""WITH {FR}, {YC}, p AS (SELECT stream_id, frame_no, y, x, cb - 128 AS cb, cr - 128 AS cr, (frame_no + y) % 4 AS ph FROM yc)
SELECT stream_id, frame_no, y, x, CASE ph WHEN 0 THEN cb WHEN 1 THEN cr WHEN 2 THEN least(127, -cb) ELSE least(127, -cr) END AS a,
  CASE ph WHEN 0 THEN cr WHEN 1 THEN least(127, -cb) WHEN 2 THEN least(127, -cr) ELSE cb END AS b FROM p""",
    "phase_walk": f"""WITH {REC}, w AS (SELECT *, sum(CASE WHEN (record_index + 1) % 7 <> 0 THEN 0 WHEN (frame_no + record_index + 1) % 2 = 0 THEN 1 ELSE -1 END)
  OVER (PARTITION BY stream_id, frame_no ORDER BY record_index ROWS UNBOUNDED PRECEDING)::INT AS walk FROM rec)
SELECT stream_id, frame_no, record_index, walk, ((phase + walk + 1 + record_index) % 4 + 4) % 4 AS phase FROM w""",
    "line_record_edits": f"""WITH {REC}, k AS (SELECT *, record_index + 1 AS k FROM rec)
SELECT stream_id, frame_no, record_index, xor(xor(flags, CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END), CASE WHEN k % 11 = 0 THEN 8 ELSE 0 END) AS flags, k % 9 = 0 AS sync_lost,
  CASE WHEN k % 5 = 0 THEN quant + 4 ELSE quant END AS quant, CASE WHEN k % 6 = 0 THEN timing + 12 + record_index ELSE timing END AS timing,
  CASE WHEN k % 13 = 0 THEN (line + 1 + record_index) % {HEIGHT} ELSE line END AS line FROM k""",
    "line_concealment": f"WITH {REC}, {EDT} SELECT stream_id, frame_no, line FROM rec EXCEPT SELECT stream_id, frame_no, line FROM edt",
    "line_last_writer": f"WITH {REC}, {EDT} SELECT stream_id, frame_no, line, max(record_index) AS record_index, count(*) AS writes FROM edt GROUP BY ALL",
    "unit_classify": f"WITH {UNI} SELECT stream_id, seq, event_id, kind, key_no, predicted_no FROM num",
    "unit_roles": f"""WITH {UNI}, e AS (SELECT uni.*, event_type FROM uni JOIN events USING (event_id)),
c AS (SELECT stream_id, seq, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 179 ELSE event_id % 175 + 1 END::INT AS code, {PIC} AS picture FROM e),
l AS (SELECT *, last_value(picture IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS latest FROM c)
SELECT stream_id, seq, code, picture, CASE WHEN code = 0 THEN 'picture' WHEN code = 179 THEN 'header' WHEN latest IN ('P', 'B') THEN 'predicted' ELSE 'slice' END AS role FROM l""",
    "keyframe_drop_recover": f"WITH {UNI} SELECT stream_id, seq, event_id, kind, key_no, predicted_no FROM num WHERE kind <> 'key' OR key_no <= 1 OR (key_no - 1) % 3 = 0",
    "drop_every_nth": f"WITH {UNI} SELECT stream_id, seq, event_id, kind, key_no, predicted_no FROM num WHERE kind <> 'predicted' OR predicted_no % 3 <> 0",
    "header_dedup": f"""WITH {UNI}, h AS (SELECT stream_id, seq, event_id, kind, CASE WHEN kind = 'header' THEN CASE event_id % 3 WHEN 0 THEN 103 WHEN 1 THEN 104 ELSE 71 END END AS header FROM uni)
SELECT * FROM h WHERE header IS NULL OR NOT EXISTS (SELECT 1 FROM h o WHERE o.stream_id = h.stream_id AND o.header = h.header AND o.seq < h.seq)""",
    "picture_types": f"""WITH {UNI}, p AS (SELECT stream_id, seq, kind, {PIC} AS picture FROM uni)
SELECT stream_id, seq, kind, last_value(picture IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS current FROM p""",
    "skip_until_next_picture": f"""WITH {UNI}, p AS (SELECT stream_id, seq, kind, {PIC} AS picture FROM uni),
n AS (SELECT *, count(*) FILTER (picture = 'I') OVER w AS i_no, max(CASE WHEN picture IS NOT NULL THEN seq END) OVER w AS head FROM p WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
s AS (SELECT n.*, h.picture = 'I' AND h.i_no > 1 AND (h.i_no - 1) % 4 <> 0 AS skipped FROM n LEFT JOIN n h ON h.stream_id = n.stream_id AND h.seq = n.head)
SELECT stream_id, seq, kind, picture, i_no FROM s WHERE NOT coalesce(skipped, false)""",
    "echo_repeat_units": f"""WITH {UNI}, b AS (SELECT *, max(CASE WHEN kind = 'predicted' THEN seq END) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM num),
l AS (SELECT stream_id, seq, list_concat(CASE WHEN kind = 'predicted' AND predicted_no % 2 = 0 AND before IS NOT NULL THEN [before] ELSE [] END,
  CASE WHEN kind = 'predicted' AND predicted_no % 3 = 0 THEN [seq, seq, seq] ELSE [seq] END) AS c FROM b)
SELECT stream_id, seq, generate_subscripts(c, 1) - 1 AS copy, unnest(c) AS source_seq FROM l""",
    "replace_with_previous": f"""WITH {UNI}, p AS (SELECT *, lag(payload) OVER (PARTITION BY stream_id ORDER BY seq) AS previous FROM num WHERE kind = 'predicted')
SELECT stream_id, seq, CASE WHEN predicted_no % 4 = 0 AND previous IS NOT NULL THEN previous ELSE payload END AS payload, predicted_no % 4 = 0 AND previous IS NOT NULL AS replaced FROM p""",
    "donor_pick": f"""WITH {UNI}, l AS (SELECT seq, payload, row_number() OVER (ORDER BY seq DESC) AS back FROM uni WHERE stream_id = 1 AND kind = 'predicted'),
d AS (SELECT payload AS donor, row_number() OVER (ORDER BY seq) - 1 AS slot, count(*) OVER () AS n FROM l WHERE back <= 16)
SELECT stream_id, seq, slot, donor FROM num JOIN d ON slot = (predicted_no * 1103515245 + n) % n WHERE kind = 'predicted'""",
    "slice_address_shift": "SELECT event_id, ((event_id % 175 - 7) % 175 + 175) % 175 + 1 AS shifted, (event_id % 175) % 4 = 2 AS dropped FROM events",
    "payload_truncate": f"WITH {UNI}, {PRE} SELECT stream_id, seq, CASE WHEN n <= 1 THEN p ELSE left(p, n - least(9, n - 1)) END AS payload FROM pair",
    "payload_splice": f"""WITH {UNI}, {PRE}, k AS (SELECT *, least(6, n, m) AS k FROM pair), a AS (SELECT *, (s * 3) % (n - k + 1) AS t, (s * 5 + 1) % (m - k + 1) AS f FROM k)
SELECT stream_id, seq, substr(p, 1, t) || substr(o, f + 1, k) || substr(p, t + k + 1) AS payload FROM a""",
    "payload_grow": f"""WITH {UNI}, {PRE}, k AS (SELECT *, least(5, m) AS k FROM pair), a AS (SELECT *, (s * 11) % (n + 1) AS t, (s * 7 + 3) % (m - k + 1) AS f FROM k)
SELECT stream_id, seq, substr(p, 1, t) || substr(o, f + 1, k) || substr(p, t + 1) AS payload FROM a""",
    "payload_rotate": f"""WITH {UNI}, {PRE}, k AS (SELECT *, least(8, n) AS k FROM pair), a AS (SELECT *, s % (n - k + 1) AS t, (s // 3) % (k - 1) + 1 AS f FROM k)
SELECT stream_id, seq, substr(p, 1, t) || substr(p, t + k - f + 1, f) || substr(p, t + 1, k - f) || substr(p, t + k + 1) AS payload FROM a""",
    "mutation_stats": f"""WITH {UNI} SELECT stream_id, count(*) AS units_in, count(*) FILTER (kind = 'key') AS keys_seen, count(*) FILTER (kind = 'predicted') AS predicted_seen,
  count(*) FILTER (kind = 'predicted' AND predicted_no % 5 = 0) AS predicted_dropped,
  count(*) FILTER (kind = 'predicted' AND predicted_no % 5 <> 0 AND predicted_no % 2 = 0) AS echo_points,
  2 * count(*) FILTER (kind = 'predicted' AND predicted_no % 5 <> 0 AND predicted_no % 3 = 0) AS predicted_repeated, sum(strlen(payload))::BIGINT AS bytes_in FROM num GROUP BY stream_id""",
}

SQL |= {
    "control_messages": """WITH e AS (SELECT user_id AS stream_id, event_id AS frame_no, event_type AS t, value AS v, props FROM events)
SELECT stream_id, frame_no, 0 AS line_no, 'preset' AS verb, 'melt' AS name, NULL::DOUBLE AS value FROM e WHERE t = 'signup'
UNION ALL SELECT stream_id, frame_no, 0, 'set', 'mv_scale', v FROM e WHERE t = 'purchase'
UNION ALL SELECT stream_id, frame_no, 2, 'set', 'residual_keep', v FROM e WHERE t = 'click'
UNION ALL SELECT stream_id, frame_no, 3, 'ping', NULL, NULL FROM e WHERE t = 'click'
UNION ALL SELECT stream_id, frame_no, 0, 'controls', '1 0.5 0.5', NULL FROM e WHERE t = 'view'
UNION ALL SELECT stream_id, frame_no, 1, 'reset-controls', NULL, NULL FROM e WHERE t = 'view'
UNION ALL SELECT stream_id, frame_no, 2, 'reset', NULL, NULL FROM e WHERE t = 'view'
UNION ALL SELECT stream_id, frame_no, 0, 'error', 'set mv_scale much', NULL FROM e WHERE t = 'error'
UNION ALL SELECT stream_id, frame_no, 1, 'error', props, NULL FROM e WHERE t = 'error'""",
    "control_latest_sample": """WITH c AS (SELECT user_id, ts, max(value) AS sample FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT v.user_id, v.ts AS at, round(least(2.0, greatest(0.0, least(8.0, 0.5::DOUBLE + (c.sample / 100 * 1.5::DOUBLE + 0.1::DOUBLE) * 0.5::DOUBLE))), 6) AS control
FROM (SELECT user_id, ts FROM events WHERE event_type = 'view') v ASOF LEFT JOIN c ON c.user_id = v.user_id AND c.ts <= v.ts""",
    "reset_hysteresis": """WITH e AS (SELECT user_id, ts, max(value) AS v FROM events GROUP BY ALL),
s AS (SELECT *, CASE WHEN v >= 60 THEN 1 WHEN v <= 20 THEN 0 END AS s FROM e),
b AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s)
SELECT user_id, ts AS "at", coalesce(s = 1 AND coalesce(p, 0) = 0, false) AS fires FROM b""",
}
