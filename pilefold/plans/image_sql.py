"""SQL for the read images of the bridge's sites, cell by cell, from the rules of the layout. Goes after the bridge's common tables."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np

from ..operators.graph import Graph, Node

SITES = """
, st AS (
  SELECT DISTINCT t.chrom, t.pos - 1 AS pos FROM (SELECT * FROM ie WHERE sample = 'T') t LEFT JOIN (SELECT * FROM ie WHERE sample = 'N') n ON t.chrom = n.chrom AND t.pos = n.pos
  WHERE n.cnt IS NULL OR abs(t.cnt - n.cnt) > 3
), sq AS (
  SELECT cg.*, translate(md5(query_name || ':' || ref_start::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS letters,
         ref_start + list_sum(list_transform(range(1, len(op) + 1), lambda k: CASE WHEN op[k] IN ('M', 'D') THEN ln[k]::BIGINT ELSE 0 END))::BIGINT AS ref_end FROM cg
)
"""

#: Reads of each site as numbered rows, their aligned and deleted bases inside the window, the reference's letters.
WINDOWS = """
, win AS (SELECT chrom, pos, greatest(pos - {before}, 0) AS lo, pos + {after} AS hi FROM st),
met AS (
  SELECT w.pos, w.lo, w.hi, s.*, row_number() OVER (PARTITION BY s.chrom, w.pos, s.sample, s.query_name ORDER BY s.file_order, s.tie, s.tie2) AS nth
  FROM win w JOIN sq s ON w.chrom = s.chrom AND s.ref_start < w.hi AND s.ref_end > w.lo
), rws AS (SELECT * EXCLUDE (nth), row_number() OVER (PARTITION BY chrom, pos, sample ORDER BY file_order, tie, tie2) - 1 AS r FROM met WHERE nth = 1),
ops AS (
  SELECT r.*, op[i] AS o, ln[i]::BIGINT AS n,
         coalesce(list_sum(list_transform(range(1, i), lambda k: CASE WHEN op[k] IN ('M', 'D') THEN ln[k]::BIGINT ELSE 0 END)), 0)::BIGINT AS ref_off,
         coalesce(list_sum(list_transform(range(1, i), lambda k: CASE WHEN op[k] = 'D' THEN 0 ELSE ln[k]::BIGINT END)), 0)::BIGINT AS read_off
  FROM rws r, unnest(range(1, len(op) + 1)) AS u(i)
), bs AS (
  SELECT chrom, pos, sample, r, o, is_reverse, mapq, lo, hi, ref_start + ref_off + k AS gp, substr(letters || letters, read_off + k + 1, 1) AS b,
         CASE WHEN o = 'M' THEN (20 + ((read_off + k + 1) * 7 + mapq) % 26)::DOUBLE
              ELSE ((20 + (read_off * 7 + mapq) % 26) + (20 + ((read_off + 1) * 7 + mapq) % 26))::DOUBLE / 2.0::DOUBLE END AS q
  FROM ops, unnest(range(0, n)) AS v(k) WHERE o IN ('M', 'D')
), pieces AS (
  SELECT w.chrom, w.pos, block_start, upper(substr(seq, greatest(lo, block_start) - block_start + 1, least(hi, block_start + 20) - greatest(lo, block_start))) AS piece
  FROM win w JOIN rf ON rf.chrom = w.chrom AND block_start < hi AND block_start + 20 > lo
), letters AS (SELECT chrom, pos, string_agg(piece, '' ORDER BY block_start) AS ref FROM pieces GROUP BY ALL)
"""


def shade(q: str) -> str:
    return f"floor(255.0::DOUBLE * (least(45, {q})::DOUBLE / 45.0::DOUBLE))::BIGINT"


def colour(letter: str, a: int, c: int, g: int, t: int) -> str:
    return f"CASE {letter} WHEN 'A' THEN {a} WHEN 'C' THEN {c} WHEN 'G' THEN {g} WHEN 'T' THEN {t} ELSE 0 END"


STRAND, MAPQ = "CASE WHEN is_reverse THEN 250 ELSE 125 END", shade("mapq")

#: The columns of an SNV image: the site's, of 31, stands five times.
SPREAD = ", spread AS (SELECT c, unnest(CASE WHEN c < 15 THEN [c] WHEN c = 15 THEN range(15, 20) ELSE [c + 4] END) AS k FROM range(0, 31) AS x(c))"


def snv_px(rows: int = 100, cells: str = "bs", more: str = "", fractions: bool = False) -> str:
    """px (chrom, pos, r, col, v0 .. v4 or v8): painted cells of the SNV image; `more` defines the table of a read's bases where it isn't bs."""
    top = 8 if fractions else 4
    none = lambda n: ", 0" * n
    out = f"""{SITES}{WINDOWS.format(before=15, after=16)}{SPREAD}{more}
, px AS (
  SELECT chrom, pos, r, CASE sample WHEN 'N' THEN 0 ELSE 35 END + k AS col, CASE WHEN o = 'D' THEN 10 ELSE {colour("b", 245, 35, 175, 105)} END AS v0, {shade("q")} AS v1, {STRAND} AS v2, {MAPQ} AS v3, {", ".join(f"0 AS v{c}" for c in range(4, top + 1))}
  FROM {cells} JOIN spread ON c = gp - (pos - 15) WHERE r < {rows}
  UNION ALL SELECT chrom, pos, row, half * 35 + k{none(top)}, {colour("substr(ref, c + 1, 1)", 245, 35, 175, 105)} FROM letters JOIN spread ON c < length(ref), range(0, {rows}) AS y(row), range(0, 2) AS z(half)
"""
    if fractions:
        share = ", ".join(f"(n{i}::DOUBLE / depth::DOUBLE)::FLOAT::DOUBLE" for i in (1, 4, 3, 2))
        out += f"  UNION ALL SELECT st.chrom, st.pos, row, CASE sample WHEN 'N' THEN 0 ELSE 35 END + k{none(4)}, {share}, 0 FROM st JOIN counted d ON d.chrom = st.chrom AND d.gp BETWEEN st.pos - 15 AND st.pos + 15 JOIN spread ON c = d.gp - (st.pos - 15), range(0, {rows}) AS y(row)\n"
    return out + ")"


SNV_PX = snv_px()

#: Bases that fall to the next free row of their column, and the counts of all reads at each place.
FALLEN_ROWS = 6
FALLEN_PX = snv_px(
    FALLEN_ROWS,
    "fallen",
    """
, fallen AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY chrom, pos, sample, gp ORDER BY r) - 1 AS r FROM bs),
counted AS (
  SELECT sample, chrom, gp, count(*) AS depth, """
    + ", ".join(f"count(*) FILTER (WHERE b = {i}) AS n{i}" for i in range(1, 5))
    + """ FROM (
    SELECT sample, chrom, ref_start + ref_off + k AS gp, strpos('ACGT', substr(letters || letters, read_off + k + 1, 1)) AS b
    FROM (
      SELECT sq.*, op[i] AS o, ln[i]::BIGINT AS n,
             coalesce(list_sum(list_transform(range(1, i), lambda k: CASE WHEN op[k] IN ('M', 'D') THEN ln[k]::BIGINT ELSE 0 END)), 0)::BIGINT AS ref_off,
             coalesce(list_sum(list_transform(range(1, i), lambda k: CASE WHEN op[k] = 'D' THEN 0 ELSE ln[k]::BIGINT END)), 0)::BIGINT AS read_off
      FROM sq, unnest(range(1, len(op) + 1)) AS u(i)
    ), unnest(range(0, n)) AS v(k) WHERE o = 'M'
  ) GROUP BY ALL
)""",
    fractions=True,
)

#: A variant put into the tumor's reads: of n reads, the first n - round(share n) with the reference's base keep it.
SPIKED_PX = snv_px(
    cells="put",
    more="""
, size AS (SELECT chrom, pos, count(*) AS n FROM rws WHERE sample = 'T' AND r < 100 GROUP BY ALL),
old AS (
  SELECT l.chrom, l.pos, substr(ref, (l.pos - lo + 1)::INT, 1) AS was, translate(upper(substr(rf.seq, (l.pos - block_start + 1)::INT, 1)), 'ACGT', 'CGTA') AS new
  FROM letters l JOIN win ON win.chrom = l.chrom AND win.pos = l.pos LEFT JOIN rf ON rf.chrom = l.chrom AND l.pos >= block_start AND l.pos < block_start + 20
),
hit AS (
  SELECT bs.chrom, bs.pos, bs.r, row_number() OVER (PARTITION BY bs.chrom, bs.pos ORDER BY bs.r) > size.n - round_even((bs.pos % 10)::DOUBLE / 10::DOUBLE * size.n::DOUBLE, 0) AND new IS NOT NULL AS changed, new
  FROM bs JOIN old ON old.chrom = bs.chrom AND old.pos = bs.pos AND b = was JOIN size ON size.chrom = bs.chrom AND size.pos = bs.pos WHERE sample = 'T' AND gp = bs.pos AND o = 'M' AND bs.r < 100
), put AS (
  SELECT bs.* REPLACE (CASE WHEN changed THEN new ELSE b END AS b) FROM bs LEFT JOIN hit ON hit.chrom = bs.chrom AND hit.pos = bs.pos AND hit.r = bs.r AND bs.sample = 'T' AND bs.gp = bs.pos AND bs.o = 'M'
)""",
)

#: The same for indels: entries of a read are its bases and, after each, room for the site's widest insertion there.
INDEL_PX = (
    SITES
    + WINDOWS.format(before=36, after=39)
    + f"""
, own AS (SELECT chrom, pos, sample, r, lo, ref_start + ref_off - 1 AS here, n, letters, read_off, mapq FROM ops WHERE o = 'I' AND r < 140 AND ref_start + ref_off - 1 >= lo AND ref_start + ref_off - 1 < lo + 75),
wd AS (SELECT chrom, pos, here, max(n) AS n FROM own GROUP BY ALL),
wl AS (SELECT chrom, pos, list(struct_pack(here := here, n := n)) AS w, coalesce(sum(n) FILTER (WHERE here < pos), 0)::BIGINT AS trim, coalesce(sum(n) FILTER (WHERE here >= pos), 0)::BIGINT AS rest FROM wd GROUP BY ALL),
ext AS (
  SELECT rws.chrom, rws.pos, sample, r, is_reverse, mapq, lo, coalesce(w, []) AS w, coalesce(trim, 0) AS trim, greatest(ref_start, lo) AS g0, least(ref_end, lo + 75) AS g1
  FROM rws LEFT JOIN wl ON wl.chrom = rws.chrom AND wl.pos = rws.pos WHERE r < 140
), sized AS (
  SELECT *, g0 - lo + coalesce(list_sum([x.n FOR x IN w IF x.here < g0]), 0)::BIGINT AS start, g1 - g0 + coalesce(list_sum([x.n FOR x IN w IF x.here >= g0 AND x.here < g1]), 0)::BIGINT - trim AS more FROM ext
), shown AS (
  SELECT *, row_number() OVER (PARTITION BY chrom, pos, sample ORDER BY r) - 1 AS row, least(more, 75 - start) AS painted FROM sized WHERE more > 0 AND start < 75
), entries AS (
  SELECT s.*, bs.gp - g0 + coalesce(list_sum([x.n FOR x IN w IF x.here >= g0 AND x.here < bs.gp]), 0)::BIGINT - trim AS e, CASE WHEN o = 'D' THEN 10 ELSE {colour("b", 250, 160, 220, 190)} END AS v0, {shade("q")} AS v1
  FROM shown s JOIN bs ON bs.chrom = s.chrom AND bs.pos = s.pos AND bs.sample = s.sample AND bs.r = s.r AND bs.gp >= g0 AND bs.gp < g1
  UNION ALL
  SELECT s.*, own.here - g0 + coalesce(list_sum([x.n FOR x IN w IF x.here >= g0 AND x.here < own.here]), 0)::BIGINT - trim + 1 + j AS e, {colour("substr(letters || letters, read_off + j + 1, 1)", 130, 40, 100, 70)} AS v0, {shade("20 + ((read_off + j + 1) * 7 + own.mapq) % 26")} AS v1
  FROM shown s JOIN own ON own.chrom = s.chrom AND own.pos = s.pos AND own.sample = s.sample AND own.r = s.r, unnest(range(0, own.n)) AS v(j)
), heights AS (SELECT chrom, pos, max(k) AS height FROM (SELECT chrom, pos, sample, count(*) AS k FROM ext GROUP BY ALL) GROUP BY ALL),
line AS (
  SELECT l.chrom, l.pos, c + coalesce(list_sum([x.n FOR x IN w IF x.here < lo + c]), 0)::BIGINT - coalesce(trim, 0) AS here, length(ref) + coalesce(list_sum([x.n FOR x IN w IF x.here < lo + length(ref)]), 0)::BIGINT - coalesce(trim, 0) - coalesce(rest, 0) AS size,
         {colour("substr(ref, c + 1, 1)", 250, 160, 220, 190)} AS v4
  FROM (SELECT l.*, win.lo FROM letters l JOIN win ON win.chrom = l.chrom AND win.pos = l.pos) l LEFT JOIN wl ON wl.chrom = l.chrom AND wl.pos = l.pos, unnest(range(0, length(ref))) AS v(c)
), px AS (
  SELECT chrom, pos, row AS r, CASE sample WHEN 'N' THEN 0 ELSE 75 END + start + e AS col, v0, v1, 0 AS v2, 0 AS v3, 0 AS v4 FROM entries WHERE e >= 0 AND e < painted
  UNION ALL SELECT chrom, pos, row, CASE sample WHEN 'N' THEN 0 ELSE 75 END + start + k, 0, 0, {STRAND}, {MAPQ}, 0 FROM shown, unnest(range(0, painted)) AS v(k)
  UNION ALL SELECT l.chrom, l.pos, row, half * 75 + here, 0, 0, 0, 0, v4 FROM line l JOIN heights h ON h.chrom = l.chrom AND h.pos = l.pos, unnest(range(0, height)) AS y(row), range(0, 2) AS z(half) WHERE here >= 0 AND here < size
)
"""
)


def sums(cells: int, width: int, channels: int = 5) -> str:
    """Each channel's sum, and its sum with each cell weighted by its place, so that a cell elsewhere shows."""
    one = ", ".join(f"coalesce(sum(v{c}), 0)::DOUBLE AS c{c}, coalesce(sum(v{c} * (r * {width} + col + 1)), 0)::DOUBLE AS w{c}" for c in range(channels))
    return f"SELECT st.chrom, st.pos, {cells} AS cells, {one} FROM st LEFT JOIN px ON px.chrom = st.chrom AND px.pos = st.pos GROUP BY st.chrom, st.pos"


@dataclass(frozen=True)
class SmallNetwork:
    """A network whose weights follow from places: a convolution by whole patches with ReLU and the channels' means meet, then a dense layer with ReLU and one score."""

    rows: int
    columns: int
    patch: tuple[int, int]
    shift: float  # of the score's logit

    @staticmethod
    def kernel(i, j, c, f):
        """-1, 0 or 1, of arrays or of SQL names."""
        return f"({i} * 7 + {j} * 5 + {c * 3 + f * 11}) % 3 - 1" if isinstance(i, str) else (i * 7 + j * 5 + c * 3 + f * 11) % 3 - 1

    @staticmethod
    def hidden(i: int, k: int) -> float:
        return ((i * 5 + k * 3) % 7 - 3) / (4096 if i < 2 else 64)

    bias, last = (-40.0, 20.0), (0.5, -0.25, 0.125)

    def graph(self) -> Graph:
        at = np.indices((*self.patch, 5, 2))
        layers = [
            Node("sites", "InputLayer", {}, ()),
            Node("patches", "Conv2D", {"kernel_size": list(self.patch), "strides": list(self.patch), "activation": "relu"}, ("sites",)),
            Node("patch_means", "GlobalAveragePooling2D", {}, ("patches",)),
            Node("channel_means", "GlobalAveragePooling2D", {}, ("sites",)),
            Node("both", "Concatenate", {}, ("patch_means", "channel_means")),
            Node("hidden", "Dense", {"activation": "relu"}, ("both",)),
            Node("score", "Dense", {"activation": "sigmoid"}, ("hidden",)),
        ]
        weights = {
            "patches": [self.kernel(*at).astype("f8"), np.array(self.bias)],
            "hidden": [np.array([[self.hidden(i, k) for k in range(3)] for i in range(7)]), np.zeros(3)],
            "score": [np.array(self.last)[:, None], np.array([self.shift])],
        }
        return Graph(layers, weights, "f8")

    def sql(self) -> str:
        """The scores from px, summed cell by cell; a patch without a cell has its bias."""
        (h, w), cells = self.patch, self.rows * self.columns
        patches = cells // (h * w)
        summed = ", ".join("sum(" + " + ".join(f"v{c} * ({self.kernel(f'(r % {h})', f'(col % {w})', c, f)})" for c in range(5)) + f")::DOUBLE AS a{f}" for f in range(2))
        means = ", ".join(f"(sum(greatest(a{f} + {b}::DOUBLE, 0::DOUBLE)) + ({patches} - count(*)) * {max(b, 0.0)}::DOUBLE) / {patches}::DOUBLE AS h{f}" for f, b in enumerate(self.bias))
        channels = ", ".join(f"sum(v{c})::DOUBLE / {cells}::DOUBLE AS h{c + 2}" for c in range(5))
        values = [f"coalesce(h{i}, {max(self.bias[i], 0.0) if i < 2 else 0.0}::DOUBLE)" for i in range(7)]
        units = " + ".join(f"{v}::DOUBLE * greatest(" + " + ".join(f"{x} * {self.hidden(i, k)}::DOUBLE" for i, x in enumerate(values)) + ", 0::DOUBLE)" for k, v in enumerate(self.last))
        return f"""
, cv AS (SELECT chrom, pos, {summed} FROM px GROUP BY chrom, pos, r // {h}, col // {w}),
hd AS (SELECT chrom, pos, {means} FROM cv GROUP BY chrom, pos),
cm AS (SELECT chrom, pos, {channels} FROM px GROUP BY chrom, pos)
SELECT st.chrom, st.pos, round_even(1::DOUBLE / (1::DOUBLE + exp(-({units} + {self.shift}::DOUBLE))), 6) AS pred_true
FROM st LEFT JOIN hd ON hd.chrom = st.chrom AND hd.pos = st.pos LEFT JOIN cm ON cm.chrom = st.chrom AND cm.pos = st.pos"""


SNV_NET, INDEL_NET = SmallNetwork(100, 70, (10, 5), 0.0), SmallNetwork(140, 150, (14, 10), 0.0)

SNV_SUMS, INDEL_SUMS, FALLEN_SUMS = sums(35_000, 70), sums(105_000, 150), sums(FALLEN_ROWS * 70 * 9, 70, 9)

#: The commonest evidence of the tumor's reads after each site: of the bridge's reads, only those of three operations have an indel.
INDEL_STATS = (
    SITES
    + """
, e AS (
  SELECT st.chrom, st.pos, CASE WHEN len(op) = 3 THEN op[2] END AS o, ln[1]::BIGINT AS x, ln[2]::BIGINT AS y, ref_start + ln[1]::BIGINT - 1 AS m, ref_end - 1 AS z, letters
  FROM st JOIN sq ON sq.chrom = st.chrom AND sq.sample = 'T' AND ref_start <= st.pos AND ref_end > st.pos
), f AS (
  SELECT chrom, pos, (o IS NULL OR pos < m OR (o = 'I' AND pos < z) OR (o = 'D' AND pos >= m + y AND pos < z))::INT AS ro,
         CASE WHEN o = 'I' AND pos = m THEN y WHEN o = 'D' AND pos >= m AND pos < m + y THEN m + y - pos END AS len, o, CASE WHEN o = 'I' THEN substr(letters, x + 1, y) END AS seq FROM e
), per AS (SELECT chrom, pos, count(*) AS dp, sum(ro)::BIGINT AS ro FROM f GROUP BY ALL),
votes AS (SELECT chrom, pos, o, seq, len, count(*) AS ao FROM f WHERE len IS NOT NULL GROUP BY ALL),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY ao DESC, o, len, seq) = 1),
b AS (
  SELECT per.*, o, seq, coalesce(len, 0)::BIGINT AS len, coalesce(ao, 0) AS ao, pos AS lo, pos + CASE WHEN o = 'D' THEN len + 1 ELSE 1 END AS hi
  FROM per LEFT JOIN best USING (chrom, pos)
), g AS (
  SELECT b.chrom, b.pos, string_agg(upper(substr(rf.seq, greatest(lo, block_start) - block_start + 1, least(hi, block_start + 20) - greatest(lo, block_start))), '' ORDER BY block_start) AS r
  FROM b JOIN rf ON rf.chrom = b.chrom AND block_start < hi AND block_start + 20 > lo GROUP BY ALL
)
SELECT b.chrom, b.pos, dp, ro, ao, printf('%.4f', ao::DOUBLE / dp::DOUBLE)::DOUBLE AS af, len, CASE WHEN o = 'D' THEN coalesce(r, '') ELSE substr(coalesce(r, ''), 1, 1) END AS ref,
       substr(coalesce(r, ''), 1, 1) || CASE WHEN o = 'I' THEN seq ELSE '' END AS alt
FROM b LEFT JOIN g USING (chrom, pos)
"""
)


def draws(k: int, seed: int, most: int) -> str:
    """SQL rows (n, i): which of n reads a seeded draw of k keeps, by Python's own generator; the bridge has at most `most` reads a site."""
    return ", ".join(f"({n}, {i})" for n in range(k + 1, most + 1) for i in random.Random(seed).sample(range(n), k))


SEEDED_SAMPLE = f"""
, dr(n, i) AS (VALUES {draws(12, 1, 60)}),
nb AS (
  SELECT sample, chrom, pos, file_order, row_number() OVER (PARTITION BY sample, chrom, pos ORDER BY file_order, l_linenumber, mapq, distance, base, baseq) - 1 AS i, count(*) OVER (PARTITION BY sample, chrom, pos) AS n FROM ab
)
SELECT sample, chrom, pos, file_order FROM nb WHERE n <= 12 OR (n, i) IN (SELECT n, i FROM dr)
"""

#: Units of a string's prefix repeats by their meaning: a unit is a prefix; it repeats up to the first letter that is not the one a unit before.
TANDEM = """
, sd AS (SELECT chrom, block_start, side, CASE side WHEN 0 THEN reverse(substr(upper(seq), 1, 10)) ELSE substr(upper(seq), 11, 10) END AS s FROM rf, range(0, 2) AS x(side)),
un(chrom, block_start, side, s, unit, breaks) AS (
  SELECT chrom, block_start, side, s, 1, list_filter(range(2, length(s) + 2), lambda i: substr(s, i, 1) <> substr(s, (i - 2) % 1 + 1, 1))[1] FROM sd
  UNION ALL
  SELECT chrom, block_start, side, s, breaks, list_filter(range(breaks + 1, length(s) + 2), lambda i: substr(s, i, 1) <> substr(s, (i - breaks - 1) % breaks + 1, 1))[1] FROM un WHERE breaks <= length(s)
), bestu AS (SELECT chrom, block_start, side, max(unit) AS unit, max_by((breaks - 1 - unit)::DOUBLE / unit::DOUBLE + 1, unit) AS repeats FROM un WHERE breaks > unit + 1 GROUP BY ALL),
bu AS (SELECT sd.chrom, sd.block_start, sd.side, coalesce(unit, 1) AS unit, coalesce(repeats, 1) AS repeats FROM sd LEFT JOIN bestu b ON b.chrom = sd.chrom AND b.block_start = sd.block_start AND b.side = sd.side)
SELECT l.chrom, l.block_start + 10 AS pos, greatest(l.unit, r.unit) AS size, CASE WHEN r.unit > l.unit THEN r.repeats WHEN l.unit > r.unit THEN l.repeats ELSE l.repeats + r.repeats END AS repeats
FROM bu l JOIN bu r ON l.chrom = r.chrom AND l.block_start = r.block_start AND l.side = 0 AND r.side = 1
"""
