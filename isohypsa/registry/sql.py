"""Oracle SQL (DuckDB) building blocks for the detection chain, written independently of the
Spark plans: equi-joins instead of slices, ray walks instead of reaches, recursion instead of
label propagation. ``chain(*names)`` renders a WITH clause holding the named steps and all they need.
"""

from __future__ import annotations

from isohypsa.registry.inputs import EVENTS_PER_INSTANT, SCENARIOS


def _bump(n: int) -> str:
    arms = []
    for k, sc in enumerate(SCENARIOS):
        amp, la, lo, sla, slo = sc[n]
        a = f"({amp}.0 + CAST(s % 11 - 5 AS DOUBLE))" if n == 0 else f"({amp}.0)"
        u, v = f"((lat - {la}) / CAST({sla} AS DOUBLE))", f"((lon - ({lo})) / CAST({slo} AS DOUBLE))"
        arms.append(f"WHEN {k} THEN CAST({a} AS DOUBLE) * exp(-({u}*{u} + {v}*{v}))")
    return "(CASE CAST(time % 3 AS INTEGER) " + " ".join(arms) + " END)"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    def rad(c: str) -> str:
        return f"(CAST({c} AS DOUBLE) * pi() / 180)"
    s1 = f"sin(({rad(lat2)} - {rad(lat1)}) / 2)"
    s2 = f"sin(({rad(lon2)} - {rad(lon1)}) / 2)"
    a = f"({s1}*{s1} + cos({rad(lat1)}) * cos({rad(lat2)}) * {s2}*{s2})"
    return f"(CAST(6371 AS DOUBLE) * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


def destination_steps(src: str, lat: str, lon: str, dist: str, bearing: str, keep: str) -> str:
    """Nested SELECT computing dest_lat, dest_lon in single precision."""
    return f"""
SELECT *, CAST(fa*180/pi() AS FLOAT) AS dest_lat, CAST(fo*180/pi() AS FLOAT) AS dest_lon FROM (
 SELECT *, CAST(CAST(lo_r + atan2(sin(be)*sin(ad)*cos(la_r), cos(ad) - sin(la_r)*sin(fa)) AS FLOAT) AS DOUBLE) AS fo FROM (
  SELECT *, CAST(CAST(asin(sin(la_r)*cos(ad) + cos(la_r)*sin(ad)*cos(be)) AS FLOAT) AS DOUBLE) AS fa FROM (
   SELECT {keep},
     CAST(CAST(CAST(CAST({lat} AS FLOAT) AS DOUBLE)*pi()/180 AS FLOAT) AS DOUBLE) AS la_r,
     CAST(CAST(CAST(CAST({lon} AS FLOAT) AS DOUBLE)*pi()/180 AS FLOAT) AS DOUBLE) AS lo_r,
     CAST({bearing} AS DOUBLE)*pi()/180 AS be, CAST({dist} AS DOUBLE)/CAST(6371 AS DOUBLE) AS ad
   FROM {src})))"""


WEIGHTS = """
SELECT *, n_i >= 1 AND n_i <= 72 AND n_j >= 0 AND n_j <= 142 AS ok,
  CAST(CAST(dn*de AS DOUBLE)/6.25::DOUBLE AS FLOAT) AS w11, CAST(CAST(ds*de AS DOUBLE)/6.25::DOUBLE AS FLOAT) AS w12,
  CAST(CAST(dn*dw AS DOUBLE)/6.25::DOUBLE AS FLOAT) AS w21, CAST(CAST(ds*dw AS DOUBLE)/6.25::DOUBLE AS FLOAT) AS w22 FROM (
 SELECT *, CAST(36 - fl AS INTEGER) AS n_i, CAST(fo2 + 72 AS INTEGER) AS n_j,
   CAST((fl+1)*2.5::DOUBLE AS FLOAT) - dest_lat AS dn, dest_lat - CAST(fl*2.5::DOUBLE AS FLOAT) AS ds,
   CAST((fo2+1)*2.5::DOUBLE AS FLOAT) - dest_lon AS de, dest_lon - CAST(fo2*2.5::DOUBLE AS FLOAT) AS dw FROM (
  SELECT *, floor(CAST(dest_lat AS DOUBLE)/2.5::DOUBLE) AS fl, floor(CAST(dest_lon AS DOUBLE)/2.5::DOUBLE) AS fo2 FROM ({src})))"""

LIMITS_SIDES = {
    "bottom": "dx > 0 AND dy BETWEEN -1 AND 1", "top": "dx < 0 AND dy BETWEEN -1 AND 1",
    "left": "dy < 0 AND dx BETWEEN -1 AND 1", "right": "dy > 0 AND dx BETWEEN -1 AND 1",
}


def snap(x: str) -> str:
    return f"(round(round(({x})/2.5::DOUBLE, 9)) * 2.5::DOUBLE + 0.0::DOUBLE)"


def unit_mean(x: str) -> str:
    return f"CAST(SUM(CAST(floor(({x})*1000000000000.0::DOUBLE + 0.5) AS BIGINT)) AS DOUBLE)/1000000000000.0::DOUBLE/COUNT(*)"


def centroid(lat: str, lon: str) -> str:
    la, lo = f"(CAST({lat} AS DOUBLE)*pi()/180)", f"(CAST({lon} AS DOUBLE)*pi()/180)"
    return (f"{unit_mean(f'cos({la})*cos({lo})')} AS ux, {unit_mean(f'cos({la})*sin({lo})')} AS uy, "
            f"{unit_mean(f'sin({la})')} AS uz")


CENTER = (f"{snap('atan2(uz, sqrt(ux*ux+uy*uy))*(180.0::DOUBLE/pi())')} AS center_lat, "
          f"{snap('atan2(uy, ux)*(180.0::DOUBLE/pi())')} AS center_lon")

_sector = ", ".join(
    f"COUNT(*) FILTER (hit AND {c}) = 17 AS {s}_all, COUNT(*) FILTER (hit AND {c}) > 17 - COUNT(*) FILTER (hit AND {c}) AS {s}_most"
    for s, c in LIMITS_SIDES.items()
)

# name -> (needs, sql)
STEPS: dict[str, tuple[list[str], str]] = {
    "synth": ([], f"SELECT CAST(event_id // {EVENTS_PER_INSTANT} AS INTEGER) AS time, SUM(CAST(round(value*100) AS BIGINT)) AS s FROM events GROUP BY 1"),
    "field": (["synth"], f"""SELECT time, i, j, CAST(floor(5900.0::DOUBLE - 8.0::DOUBLE*greatest(lat - 25, 0) + {_bump(0)} + {_bump(1)} + {_bump(2)} + 0.5) AS INTEGER) AS h
 FROM (SELECT time, s, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 90 - 2.5::DOUBLE*i AS lat, -180 + 2.5::DOUBLE*j AS lon FROM synth, range(73) a(i), range(144) b(j))"""),
    "sten0": ([], "SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(k AS INTEGER) AS k, 90 - 2.5::DOUBLE*x AS lat, -180 + 2.5::DOUBLE*y AS lon, CAST(-180 + 5*k AS DOUBLE) AS bearing FROM range(37) a(x), range(144) b(y), range(64) c(k)"),
    "sten": (["sten0"], WEIGHTS.replace("{src}", destination_steps("sten0", "lat", "lon", "500", "bearing", "x, y, k, bearing"))),
    "votes": (["field", "sten"], """SELECT time, x, y, MIN(own) AS raw,
   CAST(SUM(CASE WHEN sample IS NULL OR own >= sample THEN 1 ELSE 0 END) AS INTEGER) AS n_ge,
   CAST(SUM(CASE WHEN sample IS NOT NULL AND own <= sample THEN 1 ELSE 0 END) AS INTEGER) AS n_le FROM (
  SELECT o.time, s.x, s.y, o.h AS own, CASE WHEN s.ok THEN round(s.w11::DOUBLE*a.h + s.w12::DOUBLE*b.h + s.w21::DOUBLE*c.h + s.w22::DOUBLE*d.h) END AS sample
  FROM sten s JOIN field o ON o.i = s.x AND o.j = s.y
  LEFT JOIN field a ON a.time = o.time AND a.i = s.n_i AND a.j = s.n_j
  LEFT JOIN field b ON b.time = o.time AND b.i = s.n_i AND b.j = s.n_j + 1
  LEFT JOIN field c ON c.time = o.time AND c.i = s.n_i - 1 AND c.j = s.n_j
  LEFT JOIN field d ON d.time = o.time AND d.i = s.n_i - 1 AND d.j = s.n_j + 1) GROUP BY time, x, y"""),
    "extrema": (["votes"], "SELECT *, CASE WHEN n_ge >= 57 THEN 'MAX' WHEN n_le >= 57 THEN 'MIN' ELSE 'NO_TYPE' END AS type FROM votes"),
    "typed": (["extrema"], "SELECT time, x, y, raw, type FROM extrema WHERE type <> 'NO_TYPE'"),
    "runs": (["typed"], """SELECT time, type, x, MIN(y) AS y0, MAX(y) AS y1, MIN(x*144 + y) AS run FROM (
  SELECT *, y - row_number() OVER (PARTITION BY time, type, x ORDER BY y) AS isl FROM typed) GROUP BY time, type, x, isl"""),
    "touch": (["runs"], """SELECT a.time, a.run AS r1, b.run AS r2 FROM runs a JOIN runs b
  ON a.time = b.time AND a.type = b.type AND abs(a.x - b.x) = 1 AND b.y0 <= a.y1 + 1 AND b.y1 >= a.y0 - 1"""),
    "linked": (["runs", "touch"], """SELECT time, run, run AS reach FROM runs UNION
  SELECT l.time, l.run, t.r2 FROM linked l JOIN touch t ON t.time = l.time AND t.r1 = l.reach"""),
    "labelled": (["typed", "runs", "linked"], """SELECT t.time, t.x, t.y, t.type, t.raw, CAST(m.root AS INTEGER) AS root FROM typed t
  JOIN runs r ON r.time = t.time AND r.type = t.type AND r.x = t.x AND t.y BETWEEN r.y0 AND r.y1
  JOIN (SELECT time, run, MIN(reach) AS root FROM linked GROUP BY time, run) m ON m.time = r.time AND m.run = r.run"""),
    "summary0": (["labelled"], f"""SELECT *, {CENTER} FROM (
  SELECT time, root, type, CAST(COUNT(*) AS INTEGER) AS n_points,
    CASE WHEN type = 'MAX' THEN MIN(raw - raw % 20) ELSE MAX(raw - raw % 20) END AS contour,
    {centroid('(90 - 2.5::DOUBLE*x)', '(-180 + 2.5::DOUBLE*y)')},
    first(struct_pack(x := x, y := y) ORDER BY y, x) AS pw, first(struct_pack(x := x, y := y) ORDER BY y DESC, x) AS pe,
    first(struct_pack(x := x, y := y) ORDER BY x, y) AS pn, first(struct_pack(x := x, y := y) ORDER BY x DESC, y) AS ps
  FROM labelled GROUP BY time, root, type)"""),
    "summary": (["summary0"], "SELECT time, root, type, n_points, contour, center_lat, center_lon, " + ", ".join(
        f"90 - 2.5::DOUBLE*p{s}.x AS {s}_lat, -180 + 2.5::DOUBLE*p{s}.y AS {s}_lon" for s in "wens") + " FROM summary0"),
    "clusters": (["summary"], """SELECT *, CAST(row_number() OVER (PARTITION BY time ORDER BY root) - 1 AS INTEGER) AS id FROM summary
  WHERE n_lat > 30 AND n_lat < 85 AND n_points <> 1"""),
    "points": (["labelled", "clusters"], """SELECT l.*, c.id AS cluster, c.center_lat, c.center_lon FROM labelled l JOIN clusters c ON c.time = l.time AND c.root = l.root"""),
    "rays": ([], """SELECT CAST(row_number() OVER (ORDER BY dx, dy) - 1 AS INTEGER) AS ray, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy FROM range(-8, 9) p(dx), range(-8, 9) q(dy)
  WHERE least(abs(dx), abs(dy)) = 1 OR abs(dx) + abs(dy) = 1"""),
    "centers": (["clusters"], """SELECT *, CAST(36 - center_lat/2.5 AS INTEGER) AS ci,
   CASE WHEN CAST(center_lon/2.5 + 72 AS INTEGER) BETWEEN 0 AND 143 THEN CAST(center_lon/2.5 + 72 AS INTEGER) ELSE -1 END AS cj FROM clusters"""),
    # walk every ray cell by cell until the first stop
    "raysteps": (["centers", "rays"], f"""SELECT c.time, c.id, c.type, c.ci, c.cj, r.ray, r.dx, r.dy, CAST(k AS INTEGER) AS k, c.ci + k*r.dx AS i, c.cj + k*r.dy AS j,
   (c.ci + k*r.dx < 0 OR c.ci + k*r.dx >= 35 OR c.cj + k*r.dy < 0 OR c.cj + k*r.dy >= 144
    OR {hav('c.center_lat', 'c.center_lon', '(90 - 2.5::DOUBLE*(c.ci + k*r.dx))', '(-180 + 2.5::DOUBLE*(c.cj + k*r.dy))')} > 3000) AS stop
  FROM centers c, rays r, range(1, (SELECT MAX(j) FROM field) + 2) s(k)"""),
    "raycells": (["raysteps", "field"], """SELECT w.time, w.id, w.type, w.ray, w.dx, w.dy, w.k, CAST(w.i AS INTEGER) AS i, CAST(w.j AS INTEGER) AS j, f.h AS cell_h
  FROM (SELECT *, MIN(CASE WHEN stop THEN k END) OVER (PARTITION BY time, id, ray) AS first_stop FROM raysteps) w
  JOIN field f ON f.time = w.time AND f.i = w.i AND f.j = w.j WHERE w.k < coalesce(w.first_stop, 1000)"""),
    "walk": (["centers", "field"], f"""SELECT c.time, c.id, f.h - f.h % 20 AS level, CAST(MIN(c.ci - f.i) AS INTEGER) AS first_k FROM centers c JOIN field f
   ON f.time = c.time AND f.j = c.cj AND f.i <= c.ci AND c.ci - f.i <= 145
   WHERE c.type = 'MAX' AND c.ci <= 35 AND {hav('c.center_lat', '0', '(90 - 2.5::DOUBLE*f.i)', '0')} <= 3000 GROUP BY 1, 2, 3"""),
    # every level any MAX of the instant meets, tested against every cluster
    "tests": (["centers", "rays", "raycells", "walk"], f"""SELECT time, id, type, level, COUNT(*) FILTER (hit) = 64 AS closed, {_sector} FROM (
   SELECT c.time, c.id, c.type, l.level, r.ray, r.dx, r.dy, coalesce(bool_or(CASE WHEN c.type = 'MAX' THEN rc.cell_h < l.level ELSE rc.cell_h > l.level END), false) AS hit
   FROM centers c JOIN (SELECT DISTINCT time, level FROM walk) l ON l.time = c.time CROSS JOIN rays r
   LEFT JOIN raycells rc ON rc.time = c.time AND rc.id = c.id AND rc.ray = r.ray GROUP BY ALL) GROUP BY time, id, type, level"""),
    "pairs": (["centers"], f"""SELECT a.time, a.id AS max_id, a.center_lat AS max_center_lat, a.center_lon AS max_center_lon, a.contour AS max_contour,
   b.id AS min_id, b.center_lat AS min_center_lat, b.center_lon AS min_center_lon, b.contour AS min_contour,
   {hav('b.center_lat', 'b.center_lon', 'a.center_lat', 'a.center_lon')} AS km
   FROM centers a JOIN centers b ON a.time = b.time AND a.type = 'MAX' AND b.type = 'MIN'
   WHERE {hav('b.center_lat', 'b.center_lon', 'a.center_lat', 'a.center_lon')} <= 3000"""),
    "openlev": (["walk", "tests"], """SELECT w.time, w.id AS max_id, w.level, w.first_k,
   CASE WHEN right_most AND left_most AND NOT bottom_all THEN 'OMEGA' WHEN bottom_all AND right_all AND NOT left_all THEN 'REX' END AS search
   FROM walk w JOIN tests t ON t.time = w.time AND t.id = w.id AND t.level = w.level WHERE NOT closed"""),
    "sides": (["pairs"], """SELECT *, CASE WHEN mb < ma THEN 'WEST' WHEN mb > ma THEN 'EAST' END AS side FROM (
   SELECT *, CAST(trunc(CASE WHEN abs(max_center_lon - min_center_lon) >= 180 AND max_center_lon > min_center_lon THEN max_center_lon - 360 ELSE max_center_lon END) AS INTEGER) AS ma,
     CAST(trunc(CASE WHEN abs(max_center_lon - min_center_lon) >= 180 AND max_center_lon <= min_center_lon THEN min_center_lon - 360 ELSE min_center_lon END) AS INTEGER) AS mb FROM pairs)"""),
    "omegacand": (["sides", "openlev", "tests"], """SELECT p.time, p.max_id, o.first_k, o.level, p.min_id, p.side, p.max_center_lat, p.max_center_lon, p.min_center_lat, p.min_center_lon
   FROM sides p JOIN openlev o ON o.time = p.time AND o.max_id = p.max_id AND o.search = 'OMEGA'
   JOIN tests t ON t.time = p.time AND t.id = p.min_id AND t.level = o.level
   WHERE p.min_center_lat <= p.max_center_lat AND NOT t.closed AND p.max_contour <> p.min_contour AND p.side IS NOT NULL AND t.bottom_most
     AND (CASE WHEN p.side = 'WEST' THEN t.right_most ELSE t.left_most END)"""),
    "rexcand": (["pairs", "openlev", "tests"], """SELECT p.time, p.max_id, o.first_k, o.level, p.min_id, round(p.km, 6) AS km
   FROM pairs p JOIN openlev o ON o.time = p.time AND o.max_id = p.max_id AND o.search = 'REX'
   JOIN tests t ON t.time = p.time AND t.id = p.min_id AND t.level = o.level
   WHERE p.min_center_lat <= p.max_center_lat AND NOT t.closed AND abs(p.max_center_lon - p.min_center_lon) <= 10
     AND t.bottom_all AND t.left_all AND t.top_most"""),
    "rex": (["rexcand"], "SELECT time, max_id, first(min_id ORDER BY km, first_k, min_id) AS rex_id, MIN(km) AS rex_km FROM rexcand GROUP BY 1, 2"),
    "queue": (["omegacand"], "SELECT *, row_number() OVER (PARTITION BY time, max_id ORDER BY first_k, min_id) AS seq FROM omegacand"),
    "fold": (["queue"], f"""SELECT DISTINCT time, max_id, CAST(0 AS BIGINT) AS seq, 1e30::DOUBLE AS score, -1 AS w_id, 1e30::FLOAT::DOUBLE AS w_lat, 1e30::FLOAT::DOUBLE AS w_lon, -1 AS e_id, 1e30::FLOAT::DOUBLE AS e_lat, 1e30::FLOAT::DOUBLE AS e_lon FROM queue
   UNION ALL SELECT time, max_id, seq, CASE WHEN better THEN plain ELSE score END,
     CASE WHEN better AND side = 'WEST' THEN min_id ELSE w_id END, CASE WHEN better AND side = 'WEST' THEN la ELSE w_lat END, CASE WHEN better AND side = 'WEST' THEN lo ELSE w_lon END,
     CASE WHEN better AND side = 'EAST' THEN min_id ELSE e_id END, CASE WHEN better AND side = 'EAST' THEN la ELSE e_lat END, CASE WHEN better AND side = 'EAST' THEN lo ELSE e_lon END
   FROM (SELECT *, (side = 'WEST' OR la < e_lat) AND (CASE WHEN la < o_lat THEN plain * (1 - 0.05::DOUBLE) ELSE plain END) < score AS better FROM (
     SELECT *, (round({hav('la', 'lo', 'ta', 'tlo')}, 6) + round({hav('la', 'lo', 'o_lat', 'o_lon')}, 6) + round({hav('o_lat', 'o_lon', 'ta', 'tlo')}, 6)) / 3 AS plain FROM (
      SELECT f.time, f.max_id, q.seq, f.score, f.w_id, f.w_lat, f.w_lon, f.e_id, f.e_lat, f.e_lon, q.side, q.min_id, q.min_center_lat AS la, q.min_center_lon AS lo, q.max_center_lat AS ta, q.max_center_lon AS tlo,
       CASE WHEN q.side = 'WEST' THEN f.e_lat ELSE f.w_lat END AS o_lat, CASE WHEN q.side = 'WEST' THEN f.e_lon ELSE f.w_lon END AS o_lon
      FROM fold f JOIN queue q ON q.time = f.time AND q.max_id = f.max_id AND q.seq = f.seq + 1)))"""),
    "omega": (["fold"], """SELECT time, max_id, w_id AS west_id, e_id AS east_id, CASE WHEN w_id >= 0 OR e_id >= 0 THEN score END AS score FROM (
   SELECT *, row_number() OVER (PARTITION BY time, max_id ORDER BY seq DESC) AS last FROM fold) WHERE last = 1"""),
    "formations": (["omega", "rex"], """SELECT coalesce(o.time, r.time) AS time, coalesce(o.max_id, r.max_id) AS max_id,
   CASE WHEN r.rex_id IS NOT NULL THEN r.rex_id ELSE o.west_id END AS min1_id, CASE WHEN r.rex_id IS NOT NULL THEN -1 ELSE o.east_id END AS min2_id,
   CASE WHEN r.rex_id IS NOT NULL THEN 'REX' ELSE 'OMEGA' END AS type
   FROM (SELECT * FROM omega WHERE west_id >= 0 AND east_id >= 0) o FULL JOIN rex r ON o.time = r.time AND o.max_id = r.max_id"""),
    "hot": (["field"], "SELECT time, CAST(i//3 AS INTEGER) AS x, CAST(j//3 AS INTEGER) AS y, 90 - 2.5::DOUBLE*i AS latitude, -180 + 2.5::DOUBLE*j AS longitude, h*0.05::DOUBLE + 13.15::DOUBLE - 273.15::DOUBLE AS t_c FROM field WHERE i % 3 = 0 AND j % 3 = 0 AND i <= 36 AND h*0.05::DOUBLE + 13.15::DOUBLE - 273.15::DOUBLE > 28"),
    "hotruns": (["hot"], """SELECT time, x, MIN(y) AS y0, MAX(y) AS y1, MIN(x*48 + y) AS run FROM (
  SELECT *, y - row_number() OVER (PARTITION BY time, x ORDER BY y) AS isl FROM hot) GROUP BY time, x, isl"""),
    "hotlink": (["hotruns"], """SELECT time, run, run AS reach, x, y0, y1 FROM hotruns UNION
  SELECT l.time, l.run, b.run, b.x, b.y0, b.y1 FROM hotlink l JOIN hotruns b ON l.time = b.time AND abs(l.x - b.x) = 1 AND b.y0 <= l.y1 + 1 AND b.y1 >= l.y0 - 1"""),
    "hotlab": (["hot", "hotruns", "hotlink"], """SELECT h.*, m.root FROM hot h JOIN hotruns r ON r.time = h.time AND r.x = h.x AND h.y BETWEEN r.y0 AND r.y1
  JOIN (SELECT time, run, CAST(MIN(reach) AS INTEGER) AS root FROM hotlink GROUP BY 1, 2) m ON m.time = r.time AND m.run = r.run"""),
    "hotcent": (["hotlab"], f"""SELECT time, root, {CENTER}, CAST(dense_rank() OVER (PARTITION BY time ORDER BY root) - 1 AS INTEGER) AS id FROM (
  SELECT time, root, {centroid('latitude', 'longitude')} FROM hotlab GROUP BY time, root)"""),
}


def chain(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for need in STEPS[n][0]:
            visit(need)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    # steps read more than once are materialized so that DuckDB does not inline them repeatedly
    return "WITH RECURSIVE " + ",\n".join(
        f"{n} AS ({STEPS[n][1]})" if n in ("linked", "fold", "hotlink") else f"{n} AS MATERIALIZED ({STEPS[n][1]})"
        for n in order
    ) + "\n"
