"""ANSI SQL statements with the same results as the registered queries.

Each is written from the definition (range joins, self joins, recursion) and
not from the Spark plan, so that the two check each other.
"""

from __future__ import annotations

from quakeloom.fixed_values import (
    DECLUSTER_METHOD, EVENT_FIELDS, MODELS, OUTSIDE_REGION, STATE_BASELINE, STATE_CROSSING, STATE_ELEVATED, STATE_EXCEPTIONAL, STATE_MISSING, STATE_SMALL,
)

ORDERS = """
cat AS (
  SELECT o_orderkey AS id, o_custkey AS cust, o_orderdate + INTERVAL 3653 DAY AS ts,
    o_orderpriority AS dom,
    CASE WHEN o_orderstatus='F' THEN 'ISC' WHEN o_orderstatus='O' THEN 'IPMA' ELSE 'OTHER' END AS source,
    floor(o_totalprice/10000)/10e0 AS mag,
    36 + (o_custkey % 400)/100e0 AS lat, -12 + (o_orderkey % 500)/100e0 AS lon,
    CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 60)::DOUBLE END AS depth,
    (o_orderkey % 4)/4e0 AS q,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Mw' WHEN o_orderkey % 3 = 1 THEN 'ML' END AS mtype,
    CASE WHEN o_orderkey % 3 = 0 THEN 'reviewed_identity' WHEN o_orderkey % 3 = 1 THEN 'review_required'
      ELSE 'unknown_scale' END AS mstatus,
    (o_orderkey % 7)/20e0 AS munc,
    CASE WHEN o_orderkey % 2 = 0 THEN 'reviewed' ELSE 'preliminary' END AS rstatus,
    o_orderkey % 13 <> 0 AS pref, o_orderkey % 5 <> 0 AS bg
  FROM orders)
"""
EVENTS = """
cat AS (
  SELECT event_id AS id, ts, event_type AS dom,
    CASE WHEN event_id % 3 = 0 THEN 'IPMA' WHEN event_id % 3 = 1 THEN 'ISC' ELSE 'AHEAD' END AS source,
    CASE WHEN event_id % 17 <> 0 THEN floor(value)/100e0 END AS mag,
    36 + (user_id % 40)/10e0 AS lat, -12 + (user_id % 50)/10e0 AS lon,
    CASE WHEN event_id % 11 <> 0 THEN (user_id % 60)::DOUBLE END AS depth,
    (event_id % 4)/4e0 AS q,
    CASE WHEN event_id % 3 = 0 THEN 'Mw' WHEN event_id % 3 = 1 THEN 'ML' END AS mtype,
    CASE WHEN event_id % 2 = 0 THEN 'reviewed' ELSE 'preliminary' END AS rstatus
  FROM events)
"""
EPOCH = """CASE WHEN {y} IS NULL THEN 'contemporary_network' WHEN {y} <= 1899 THEN 'historical_pre_instrumental'
 WHEN {y} <= 1963 THEN 'early_instrumental' WHEN {y} <= 2007 THEN 'modern_network'
 ELSE 'contemporary_network' END"""
LABEL = """CASE {e} WHEN 'historical_pre_instrumental' THEN 'Histórica pré-instrumental'
 WHEN 'early_instrumental' THEN 'Instrumental inicial' WHEN 'modern_network' THEN 'Rede instrumental moderna'
 ELSE 'Período instrumental contemporâneo' END"""
FLOOR = """CASE {e} WHEN 'historical_pre_instrumental' THEN 5e0 WHEN 'early_instrumental' THEN 4e0
 WHEN 'modern_network' THEN 3e0 ELSE 1.5e0 END"""


def hav(a: str, b: str, c: str, d: str) -> str:
    return (
        f"2*6371.0088e0*asin(sqrt(least(1e0, pow(sin((radians({c})-radians({a}))/2),2)"
        f"+cos(radians({a}))*cos(radians({c}))*pow(sin((radians({d})-radians({b}))/2),2))))"
    )


def mc(source: str, keys: str, minimum: int, name: str) -> str:
    """CTEs ending in ``name``: keys, mc, n (maximum curvature on 0.1 bins)."""
    k = f"{keys}," if keys else ""
    on = " AND ".join(f"v.{c} IS NOT DISTINCT FROM x.{c}" for c in keys.split(",")) if keys else "true"
    return f"""
{name}_x AS (SELECT {k} min(mag) AS mn, count(*) AS n FROM {source} WHERE mag IS NOT NULL {'GROUP BY ' + keys if keys else ''}),
{name}_v AS (SELECT {k} mag, count(*) AS c FROM {source} WHERE mag IS NOT NULL GROUP BY {k} mag),
{name}_b AS (
  SELECT {', '.join('x.' + c for c in keys.split(',')) + ',' if keys else ''} x.mn, x.n, v.c,
    (SELECT max(k) FROM range(0, 200) t(k)
      WHERE floor(x.mn/1e-1)*1e-1 + k*((floor(x.mn/1e-1)*1e-1 + 1e-1) - floor(x.mn/1e-1)*1e-1) <= v.mag) AS bin
  FROM {name}_v v JOIN {name}_x x ON {on}),
{name}_h AS (SELECT {k} mn, n, bin, sum(c) AS c FROM {name}_b GROUP BY {k} mn, n, bin),
{name} AS (
  SELECT {k} n, CASE WHEN n >= {minimum} THEN
    round(floor(mn/1e-1)*1e-1 + arg_max(bin, c*1000 - bin)*((floor(mn/1e-1)*1e-1 + 1e-1) - floor(mn/1e-1)*1e-1) + 5e-2, 2) END AS mc
  FROM {name}_h GROUP BY {k} mn, n)"""


SCENARIOS = ", ".join(f"({m}e0, {h})" for m in ("3.5", "4", "4.5", "5") for h in (7, 30, 90))
SEQUENCE_ID = "CASE WHEN m.id IS NOT NULL THEN m.seq ELSE o.seq END"
SEQUENCE_ROLE = (
    "CASE WHEN eq.id IS NULL THEN 'ineligible' WHEN m.id IS NOT NULL THEN 'mainshock'"
    " WHEN k.id IS NOT NULL THEN 'associated_event' ELSE 'background' END"
)


def sequences(catalogue: str, where: str) -> str:
    """CTEs of the greedy declustering: eq (eligible), claim (id, owner) and main (id, seq).

    In order of size and time, an unclaimed candidate claims the later, not
    larger events in its window. Round by round, a candidate is settled when
    each earlier one that covers it is: claimed by one that is not, or free.
    """
    return f"""
eq AS (SELECT id, ts, lat, lon, mag, least(180e0, greatest(12e0, pow(10, mag*0.5e0 - 0.75e0))) AS radius,
    least(365e0, greatest(1e0, pow(10, mag*0.8e0 - 1.2e0))) AS days FROM {catalogue} WHERE {where} AND mag IS NOT NULL),
cand AS (SELECT *, row_number() OVER (ORDER BY mag DESC, ts, id::VARCHAR) AS p FROM eq WHERE mag >= 3),
pairs AS MATERIALIZED (SELECT a.id AS c, a.p, b.id AS e FROM cand a JOIN eq b ON b.ts > a.ts AND b.mag <= a.mag
    AND epoch_us(b.ts) - epoch_us(a.ts) <= a.days*86400000000 AND {hav('b.lat', 'b.lon', 'a.lat', 'a.lon')} <= a.radius),
state(id, s, r) AS (SELECT id, 0, 0 FROM cand UNION ALL
  SELECT st.id, CASE WHEN st.s <> 0 THEN st.s WHEN x.taken THEN 2 WHEN x.open THEN 0 ELSE 1 END, st.r + 1
  FROM state st LEFT JOIN (SELECT e, bool_or(s = 1) AS taken, bool_or(s = 0) AS open FROM pairs JOIN state y ON y.id = c GROUP BY e) x ON x.e = st.id
  WHERE EXISTS (SELECT 1 FROM state WHERE s = 0)),
free AS (SELECT id FROM state WHERE s = 1 AND r = (SELECT max(r) FROM state)),
claim AS (SELECT e AS id, arg_min(c, p) AS owner FROM pairs WHERE c IN (SELECT id FROM free) GROUP BY e),
main AS (SELECT id, 'SEQ-' || lpad(row_number() OVER (ORDER BY p)::VARCHAR, 6, '0') AS seq FROM cand WHERE id IN (SELECT owner FROM claim))"""


def features(where: str = "pref", windows: str = "30),(90),(365", catalogue: str = ORDERS) -> str:
    """CTEs ending in ``feat``: all window features of one population."""
    return f"""
{catalogue},
pop AS (SELECT *, {EPOCH.format(y='year(ts)')} AS epoch, ts::DATE AS d FROM cat WHERE {where}),
{mc('pop', 'dom,epoch', 30, 'emc')},
sizes AS (SELECT dom, epoch, count(*) AS epoch_n, min(d) AS d0, max(d) - min(d) AS span FROM pop GROUP BY dom, epoch),
thr AS (
  SELECT s.*, m.mc AS epoch_mc,
    format('{{:.1f}}', greatest({FLOOR.format(e='s.epoch')}, coalesce(m.mc, 0e0)))::DOUBLE AS thr
  FROM sizes s LEFT JOIN emc m USING (dom, epoch)),
win AS (
  SELECT dom, epoch, w, i, thr, epoch_mc, epoch_n, d0 + (7*i)::INT AS ws, (d0 + (7*i)::INT) + w - 1 AS we
  FROM thr, (VALUES ({windows})) t(w), range(0, 2000) r(i)
  WHERE span >= w - 1 AND 7*i <= span - (w - 1)),
hit AS (
  SELECT n.dom, n.epoch, n.w, n.i, p.*  EXCLUDE (dom, epoch), coalesce(p.mag >= n.thr, false) AS comp
  FROM win n JOIN pop p ON p.dom = n.dom AND p.epoch = n.epoch AND p.d BETWEEN n.ws AND n.we),
cen AS (SELECT dom, epoch, w, i, avg(lat) AS clat, avg(lon) AS clon FROM hit WHERE comp GROUP BY ALL),
dis AS (
  SELECT h.dom, h.epoch, h.w, h.i, quantile_cont({hav('h.lat', 'h.lon', 'c.clat', 'c.clon')}, 0.5) AS disp
  FROM hit h JOIN cen c USING (dom, epoch, w, i) WHERE h.comp GROUP BY ALL),
{mc('hit', 'dom,epoch,w,i', 20, 'wmc')},
agg AS (
  SELECT dom, epoch, w, i, count(*) AS n, count(*) FILTER (comp) AS cn,
    max(mag) FILTER (comp) AS mx, avg(mag) FILTER (comp) AS mean_m, median(depth) FILTER (comp) AS med_depth,
    stddev_pop(depth) FILTER (comp) AS sd_depth,
    log10(sum(pow(10, 1.5e0*mag + 4.8e0)) FILTER (comp)) AS energy, avg(q) AS quality,
    avg((mag IS NOT NULL)::INT) AS mag_cov, avg((depth IS NOT NULL)::INT) FILTER (comp) AS depth_cov,
    avg((lat IS NOT NULL AND lon IS NOT NULL)::INT) FILTER (comp) AS loc_cov,
    avg((source = 'IPMA')::INT) AS s_ipma, avg((source = 'ISC')::INT) AS s_isc, avg((source = 'AHEAD')::INT) AS s_ahead
  FROM hit GROUP BY ALL),
dom_src AS (
  SELECT dom, epoch, w, i, source AS dominant FROM (
    SELECT dom, epoch, w, i, source, row_number() OVER (PARTITION BY dom, epoch, w, i ORDER BY count(*) DESC, source) AS r
    FROM hit GROUP BY dom, epoch, w, i, source) WHERE r = 1),
feat AS (
  SELECT n.dom, n.epoch, n.w, n.ws, n.we, n.thr, n.epoch_mc, n.epoch_n, a.n, a.n*30e0/n.w AS rate, a.cn, a.cn*30e0/n.w AS crate,
    a.mx, a.mean_m, a.med_depth, coalesce(a.sd_depth, 0) AS sd_depth, coalesce(d.disp, 0) AS disp, a.energy,
    (SELECT greatest(0, epoch_us(n.we::TIMESTAMP) - epoch_us(max(p.ts)))/86400e6 FROM pop p
      WHERE p.dom = n.dom AND p.epoch = n.epoch AND p.ts < n.we::TIMESTAMP AND p.mag >= greatest(3e0, n.thr)) AS since,
    m.mc, a.quality, a.mag_cov, a.depth_cov, a.loc_cov, a.s_ipma, a.s_isc, a.s_ahead,
    greatest(0, 1 - (a.s_ipma + a.s_isc + a.s_ahead)) AS s_other, s.dominant
  FROM win n JOIN agg a USING (dom, epoch, w, i) LEFT JOIN dis d USING (dom, epoch, w, i)
  LEFT JOIN wmc m USING (dom, epoch, w, i) JOIN dom_src s USING (dom, epoch, w, i))"""


FEATURE_LIST = """dom AS tectonic_domain, w AS window_days, ws::VARCHAR AS window_start, we::VARCHAR AS window_end,
 epoch AS comparison_epoch, thr AS comparison_magnitude_threshold, epoch_mc AS epoch_catalogue_mc,
 epoch_n::BIGINT AS epoch_event_count, n::BIGINT AS event_count, round(rate,6) AS event_rate_per_30d,
 cn::BIGINT AS comparable_event_count, round(crate,6) AS comparable_event_rate_per_30d,
 mx AS maximum_magnitude, round(mean_m,9) AS mean_magnitude, med_depth AS median_depth_km,
 round(sd_depth,6) AS depth_std_km, round(disp,6) AS spatial_dispersion_km, round(energy,6) AS log10_total_energy_j,
 round(since,6) AS days_since_previous_m3, mc AS catalogue_completeness_mc, round(quality,9) AS data_quality_score,
 round(mag_cov,6) AS magnitude_coverage_ratio, round(depth_cov,6) AS depth_coverage_ratio,
 round(loc_cov,6) AS location_coverage_ratio, round(s_ipma,6) AS source_share_ipma, round(s_isc,6) AS source_share_isc,
 round(s_ahead,6) AS source_share_ahead, round(abs(s_other),6) AS source_share_other,
 round(least(1, ((CASE WHEN s_ipma>0 THEN -s_ipma*ln(s_ipma) ELSE 0 END)+(CASE WHEN s_isc>0 THEN -s_isc*ln(s_isc) ELSE 0 END)
  +(CASE WHEN s_ahead>0 THEN -s_ahead*ln(s_ahead) ELSE 0 END)+(CASE WHEN s_other>0 THEN -s_other*ln(s_other) ELSE 0 END))/ln(4)),6)
  AS source_diversity_score, dominant AS dominant_source"""


def percentile(keys: str, value: str, prefix: str) -> str:
    """CTE ``prefix`` over ``feat``: expanding percentile columns of a series."""
    same = " AND ".join(f"b.{k} = a.{k}" for k in keys.split(","))
    over = f"OVER (PARTITION BY {keys} ORDER BY we ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{prefix}_lag AS (SELECT *, lag({value}) OVER (PARTITION BY {keys} ORDER BY we) AS pv FROM feat),
{prefix}_run AS (
  SELECT *, count(*) {over} AS refs, count(pv) {over} AS k, sum(pv) {over} AS sx,
    sum(CASE WHEN pv IS NOT NULL THEN {value} END) {over} AS sy, sum(pv*pv) {over} AS sxx,
    sum(CASE WHEN pv IS NOT NULL THEN {value}*{value} END) {over} AS syy, sum(pv*{value}) {over} AS sxy,
    ceil(w/7e0)::INT AS ovl
  FROM {prefix}_lag),
{prefix}_cnt AS (
  SELECT a.dom, a.w, a.we, count(*) AS le FROM feat a JOIN feat b ON {same} AND b.we < a.we AND b.{value} <= a.{value} GROUP BY ALL),
{prefix}_rho AS (
  SELECT r.*, coalesce(c.le, 0) AS le, CASE WHEN k >= 2 AND (k*sxx-sx*sx) > 0 AND (k*syy-sy*sy) > 0 THEN
    greatest(-0.99e0, least(0.99e0, (k*sxy-sx*sy)::DOUBLE/sqrt((k*sxx-sx*sx)::DOUBLE*(k*syy-sy*sy)::DOUBLE))) END AS rho
  FROM {prefix}_run r LEFT JOIN {prefix}_cnt c USING (dom, w, we)),
{prefix}_eff AS (
  SELECT *, CASE WHEN refs > 0 THEN greatest(1e0, least(refs::DOUBLE, greatest(1e0, refs/ovl::DOUBLE),
     greatest(1e0, CASE WHEN rho > 0 THEN refs*(1-rho)/(1+rho) ELSE refs END))) ELSE 0e0 END AS eff,
     CASE WHEN refs >= 10 THEN le/refs::DOUBLE END AS p
  FROM {prefix}_rho),
{prefix} AS (
  SELECT *, CASE WHEN p IS NOT NULL THEN greatest(0e0, ctr - mar) END AS lo, CASE WHEN p IS NOT NULL THEN least(1e0, ctr + mar) END AS hi FROM (
    SELECT *, (p + 3.841458820694124e0/(2*eff))/(1 + 3.841458820694124e0/eff) AS ctr,
      1.959963984540054e0*sqrt(p*(1-p)/eff + 3.841458820694124e0/(4*eff*eff))/(1 + 3.841458820694124e0/eff) AS mar
    FROM {prefix}_eff))"""


def percentile_list(alias: str, prefix: str) -> str:
    return f"""round({alias}.p,6) AS {prefix}_percentile_event_rate, {alias}.refs::INT AS {prefix}_reference_windows,
 round({alias}.eff,6) AS {prefix}_effective_sample_size, round({alias}.lo,6) AS {prefix}_percentile_ci_lower,
 round({alias}.hi,6) AS {prefix}_percentile_ci_upper, {alias}.ovl AS {prefix}_overlap_factor,
 round({alias}.rho,6) AS {prefix}_lag1_autocorrelation"""


REGION_EDGES = """
edges(reg, ord, area, x1, y1, x2, y2) AS (VALUES
 ('Margem Sudoeste Ibérica',1,36e0,-14.8e0,34e0,-7e0,34e0),('Margem Sudoeste Ibérica',1,36e0,-7e0,34e0,-7e0,38.4e0),
 ('Margem Sudoeste Ibérica',1,36e0,-7e0,38.4e0,-9.1e0,39e0),('Margem Sudoeste Ibérica',1,36e0,-9.1e0,39e0,-11.8e0,39.3e0),
 ('Margem Sudoeste Ibérica',1,36e0,-11.8e0,39.3e0,-14.8e0,38.3e0),('Margem Sudoeste Ibérica',1,36e0,-14.8e0,38.3e0,-14.8e0,34e0),
 ('Vale Inferior do Tejo',2,1e0,-9.65e0,38.35e0,-8.55e0,38.35e0),('Vale Inferior do Tejo',2,1e0,-8.55e0,38.35e0,-8.3e0,39.45e0),
 ('Vale Inferior do Tejo',2,1e0,-8.3e0,39.45e0,-9.1e0,39.7e0),('Vale Inferior do Tejo',2,1e0,-9.1e0,39.7e0,-9.7e0,39.1e0),
 ('Vale Inferior do Tejo',2,1e0,-9.7e0,39.1e0,-9.65e0,38.35e0))"""

SCORES = """
scores AS (
  SELECT d.doc_id, l.toxic AS o, m.model, m.p, pow(m.p - l.toxic, 2) AS brier,
    pow(0.25e0 - l.toxic, 2) AS be, pow((d.doc_id % 7)/7e0 - l.toxic, 2) AS bp
  FROM documents d JOIN labels l USING (doc_id),
  LATERAL (VALUES ('Famílias — score bruto', (d.n_chars % 101)/100e0), ('Frequência empírica', 0.25e0),
    ('Poisson', (d.doc_id % 7)/7e0)) m(model, p))"""
CAL_BIN = "(SELECT min(k) FROM range(1, {b} + 1) t(k) WHERE p <= k*(1e0/{b}) OR k = {b})"


def wilson(p: str, n: str) -> tuple[str, str]:
    z2 = "3.841458820694124e0"
    ctr = f"(({p}) + {z2}/(2*({n})))/(1 + {z2}/({n}))"
    mar = f"1.959963984540054e0*sqrt(({p})*(1-({p}))/({n}) + {z2}/(4e0*({n})*({n})))/(1 + {z2}/({n}))"
    return f"greatest(0e0, {ctr} - {mar})", f"least(1e0, {ctr} + {mar})"


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    feat, feat90 = features(), features(windows="90")

    out["schema_conformance"] = """
SELECT o_orderkey::VARCHAR AS event_id, CASE WHEN lat BETWEEN -90 AND 90 THEN lat END AS latitude,
  CASE WHEN lon BETWEEN -180 AND 180 THEN lon END AS longitude, CASE WHEN dep BETWEEN -10 AND 800 THEN dep END AS depth_km,
  CASE WHEN m BETWEEN -3 AND 10.5 THEN m END AS magnitude_value, CASE WHEN m BETWEEN -3 AND 10.5 THEN m END AS magnitude_original_value,
  true AS is_preferred_record, false AS is_background_event
FROM (SELECT *, (o_custkey % 200 - 95)::DOUBLE AS lat, (o_orderkey % 400 - 200)::DOUBLE AS lon,
  CASE WHEN o_orderkey % 9 = 0 THEN -99e0 ELSE (o_custkey % 1000)::DOUBLE END AS dep,
  CASE WHEN o_orderkey % 5 = 0 THEN -99e0 ELSE floor(o_totalprice/10000)/4e0 END AS m FROM orders)"""
    out["stable_event_ids"] = """
SELECT event_id::VARCHAR AS source_event_id, 'MEM-' || upper(substr(sha1(event_type || '|' || event_id::VARCHAR || '|' ||
  strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || strftime(ts, '%f') ELSE '' END || '+00:00' || '|' ||
  CASE WHEN lat <> 0 THEN lat::VARCHAR ELSE '' END || '|' || CASE WHEN lon <> 0 THEN lon::VARCHAR ELSE '' END), 1, 16)) AS event_id
FROM (SELECT *, (user_id % 40)/10e0 AS lat, -12 + (user_id % 50)/10e0 AS lon FROM events)"""
    out["scalar_parsing"] = """
SELECT event_id, value AS parsed_value,
  CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN true END AS parsed_flag,
  epoch_us(date_trunc('second', ts))::BIGINT AS parsed_us, epoch_us(date_trunc('day', ts))::BIGINT AS parsed_day_us,
  CASE event_id % 3 WHEN 0 THEN 'MW' WHEN 1 THEN 'UNKNOWN' ELSE 'UNKNOWN' END AS magnitude_type,
  CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'fallback' END AS first_text
FROM events"""
    out["magnitude_homogenisation"] = f"""
WITH {ORDERS} SELECT id::VARCHAR AS event_id,
  CASE WHEN mtype = 'ML' AND mag IS NOT NULL THEN round(mag*0.9e0 + 0.2e0, 6) ELSE mag END AS magnitude_comparable,
  CASE WHEN mtype = 'Mw' THEN 'moment_magnitude_identity' WHEN mtype = 'ML' THEN 'affine_policy' ELSE 'identity_fallback_unvalidated' END AS method,
  CASE WHEN mtype = 'Mw' THEN 'Mcomp = Mw' WHEN mtype = 'ML' THEN 'Mcomp=0.9×M+0.2' ELSE 'Mcomp ≈ Moriginal (conversão não validada)' END AS equation,
  CASE WHEN mtype = 'Mw' THEN greatest(munc, 0.1e0) WHEN mtype = 'ML' THEN greatest(munc, 0.3e0) ELSE greatest(munc, 0.5e0) END AS uncertainty,
  CASE WHEN mtype = 'Mw' THEN 'reviewed_identity' WHEN mtype = 'ML' THEN 'approved_conversion' ELSE 'unknown_scale' END AS status
FROM cat"""
    out["magnitude_audit"] = f"""
WITH {ORDERS} SELECT CASE mtype WHEN 'Mw' THEN 'MW' WHEN 'ML' THEN 'ML' ELSE 'UNKNOWN' END AS magnitude_original_type,
  mstatus AS magnitude_homogenization_status, 'not_processed' AS magnitude_homogenization_method, count(*)::BIGINT AS records,
  round(median(munc), 6) AS median_uncertainty, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day
FROM cat GROUP BY 1, 2"""
    out["magnitude_policy_counts"] = f"""
WITH {ORDERS} SELECT count(*)::BIGINT AS preferred_events, count(mag)::BIGINT AS events_with_magnitude,
  count(*) FILTER (mstatus = 'reviewed_identity' AND mag IS NOT NULL)::BIGINT AS validated_events,
  count(*) FILTER (mstatus IN ('review_required','unknown_scale'))::BIGINT AS fallback_events, (count(*) - count(mag))::BIGINT AS missing_events,
  round(count(*) FILTER (mstatus = 'reviewed_identity' AND mag IS NOT NULL)/count(*)::DOUBLE, 6) AS validated_fraction_total,
  round(count(*) FILTER (mstatus = 'reviewed_identity' AND mag IS NOT NULL)/count(mag)::DOUBLE, 6) AS validated_fraction_with_magnitude
FROM cat WHERE pref"""
    out["epoch_assignment"] = f"""
WITH {ORDERS}, y AS (SELECT id, (800 + id % 1300)::INT AS y FROM cat)
SELECT {EPOCH.format(y='y')} AS observation_epoch, {LABEL.format(e='(' + EPOCH.format(y='y') + ')')} AS observation_epoch_label,
  {FLOOR.format(e='(' + EPOCH.format(y='y') + ')')} AS floor, count(*)::BIGINT AS events, min(y) AS first_year, max(y) AS last_year
FROM y GROUP BY 1, 2, 3"""
    placed = f"""
{REGION_EDGES},
pts AS (SELECT DISTINCT lat, lon FROM cat),
test AS (
  SELECT p.lat, p.lon, e.reg, e.ord, e.area,
    bool_or((p.lon-x1)*(y2-y1)-(p.lat-y1)*(x2-x1) = 0 AND p.lon BETWEEN least(x1,x2) AND greatest(x1,x2) AND p.lat BETWEEN least(y1,y2) AND greatest(y1,y2)) AS border,
    sum(CASE WHEN y1 <> y2 AND (y1 > p.lat) <> (y2 > p.lat) AND p.lon < (x2-x1)*(p.lat-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END) AS crossings,
    min(sqrt(pow(p.lon-(x1+t*(x2-x1)),2)+pow(p.lat-(y1+t*(y2-y1)),2))) AS dist
  FROM pts p, edges e, LATERAL (SELECT greatest(0e0, least(1e0, ((p.lon-x1)*(x2-x1)+(p.lat-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t) k
  GROUP BY 1, 2, 3, 4, 5),
per AS (
  SELECT lat, lon, count(*) FILTER (border OR crossings % 2 = 1) AS hits, arg_min(reg, area) FILTER (border OR crossings % 2 = 1) AS inside,
    arg_min(reg, dist*1000000 + ord*1e-9) AS near, min(dist) AS dist
  FROM test GROUP BY 1, 2)"""
    region = "CASE WHEN hits > 0 THEN inside WHEN dist <= 0.25 THEN near ELSE 'Fora dos domínios piloto' END"
    out["region_assignment"] = f"""
WITH {ORDERS}, {placed}
SELECT c.id::VARCHAR AS event_id, {region} AS tectonic_domain,
  CASE WHEN hits = 1 THEN 0.9e0 WHEN hits > 1 THEN 0.85e0 WHEN dist <= 0.25 THEN 0.45e0 ELSE 0.2e0 END AS domain_confidence
FROM cat c JOIN per USING (lat, lon)"""
    out["population_filters"] = f"""
WITH {ORDERS}, m(mode) AS (VALUES ('complete'), ('declustered')), p(policy) AS (VALUES ('operational'), ('validated'))
SELECT mode AS catalogue_mode, policy AS magnitude_policy, dom AS tectonic_domain, count(*)::BIGINT AS events, round(avg(mag), 6) AS mean_magnitude
FROM cat, m, p WHERE pref AND (mode = 'complete' OR bg) AND (policy = 'operational' OR (mstatus = 'reviewed_identity' AND mag IS NOT NULL))
GROUP BY 1, 2, 3"""
    out["eligibility_reasons"] = """
SELECT reason, count(*)::BIGINT AS records FROM (
  SELECT CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 3 = 0 THEN 'missing_' || concat_ws('_',
    CASE WHEN event_id % 7 = 0 THEN 'data' END, CASE WHEN event_id % 5 = 0 THEN 'coordenadas' END, CASE WHEN event_id % 3 = 0 THEN 'magnitude' END)
    ELSE 'eligible' END AS reason FROM events) GROUP BY 1"""
    out["scalar_physics"] = f"""
WITH {EVENTS} SELECT id AS event_id, round({hav('lat', 'lon', '38e0', '-9e0')}, 6) AS distance_km,
  round(log10(pow(10, 1.5e0*mag + 4.8e0)), 6) AS log_energy,
  CASE WHEN mag IS NOT NULL THEN round(least(180e0, greatest(12e0, pow(10, 0.5e0*mag - 0.75e0))), 6) END AS radius_km,
  CASE WHEN mag IS NOT NULL THEN round(least(365e0, greatest(1e0, pow(10, 0.8e0*mag - 1.2e0))), 6) END AS window_days FROM cat"""
    lo, hi = wilson("p", "n")
    out["wilson_and_sample_size"] = f"""
SELECT o_custkey, n::BIGINT AS n, round({lo}, 6) AS lower, round({hi}, 6) AS upper, ceil(90/7e0)::INT AS overlap,
  round(greatest(1e0, least(n::DOUBLE, greatest(1e0, n/13e0), greatest(1e0, CASE WHEN rho > 0 THEN n*(1-rho)/(1+rho) ELSE n END))), 6) AS effective,
  round(CASE WHEN p > 0 THEN 1 - (p*p)/p END, 6) AS skill
FROM (SELECT o_custkey, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS p, (o_custkey % 20 - 5)/20e0 AS rho FROM orders GROUP BY o_custkey)"""
    out["display_formats"] = f"""
WITH {ORDERS} SELECT id AS event_id, strftime(ts, '%d/%m/%Y') AS day_text, strftime(ts, '%d/%m/%Y %H:%M UTC') AS time_text,
  strftime(ts, '%Y-%m') AS month_text, strftime(ts, '%Y%m%dT%H%M%SZ') AS slug,
  CASE WHEN depth IS NULL THEN '—' ELSE depth::INT::VARCHAR || '.0 km' END AS depth_text,
  CASE WHEN pref THEN 'Sim' ELSE 'Não' END AS preferred_text, (id % 100)::VARCHAR || '.0%' AS quality_text,
  'FAM-' || strftime(ts, '%Y%m%d') || '-' || strftime(ts + INTERVAL 30 DAY, '%Y%m%d') AS family_id, 'EPI-' || strftime(ts, '%Y%m%d') AS episode_id
FROM cat"""
    out["window_counts"] = f"""
WITH {features()} SELECT dom AS tectonic_domain, epoch AS comparison_epoch, w AS window_days, ws::VARCHAR AS window_start,
  we::VARCHAR AS window_end, n::BIGINT AS event_count FROM feat"""
    out["window_features_full"] = f"WITH {feat} SELECT {FEATURE_LIST} FROM feat"
    out["fingerprints"] = f"""
WITH {feat}, {percentile('dom,w', 'n', 'h')}, {percentile('dom,w,epoch', 'cn', 'c')}
SELECT h.dom AS tectonic_domain, h.w AS window_days, h.we::VARCHAR AS window_end, h.n::BIGINT AS event_count, h.cn::BIGINT AS comparable_event_count,
{percentile_list('h', 'historical')}, {percentile_list('c', 'comparable')}
FROM h JOIN c USING (dom, w, we)"""
    parts = []
    for mode, m in (("complete", "pref"), ("declustered", "pref AND bg")):
        for policy, p in (("operational", ""), ("validated", " AND mstatus = 'reviewed_identity' AND mag IS NOT NULL")):
            parts.append(
                f"SELECT * FROM (WITH {features(m + p)}, {percentile('dom,w', 'n', 'h')}, {percentile('dom,w,epoch', 'cn', 'c')} "
                f"SELECT '{mode}' AS catalogue_mode, '{policy}' AS magnitude_policy, "
                "h.dom AS tectonic_domain, h.w AS window_days, h.we::VARCHAR AS window_end, h.thr AS comparison_magnitude_threshold, "
                "h.n::BIGINT AS event_count, h.cn::BIGINT AS comparable_event_count, h.mx AS maximum_magnitude, h.med_depth AS median_depth_km, "
                f"round(h.disp,6) AS spatial_dispersion_km, {percentile_list('h', 'historical')}, {percentile_list('c', 'comparable')} "
                "FROM h JOIN c USING (dom, w, we))"
            )
    out["fingerprints_all_populations"] = " UNION ALL ".join(parts)
    sides = [
        f"SELECT * FROM (WITH {features(m, windows='90')}, {percentile('dom,w,epoch', 'cn', 'c')} "
        f"SELECT 'operational' AS magnitude_policy, dom AS tectonic_domain, w AS window_days, '{mode}' AS catalogue_mode, we::VARCHAR AS window_end, "
        "n::BIGINT AS event_count, round(crate, 6) AS comparable_event_rate_per_30d, round(p, 6) AS comparable_percentile_event_rate, "
        "round(lo, 6) AS comparable_percentile_ci_lower, round(hi, 6) AS comparable_percentile_ci_upper "
        "FROM c QUALIFY row_number() OVER (PARTITION BY dom ORDER BY we DESC) = 1)"
        for mode, m in (("complete", "pref"), ("declustered", "pref AND bg"))
    ]
    out["mode_sensitivity"] = " UNION ALL ".join(sides)
    out["domain_epoch_thresholds"] = f"""
WITH {features()} SELECT t.dom AS tectonic_domain, t.epoch AS observation_epoch, {LABEL.format(e='t.epoch')} AS epoch_label,
  {FLOOR.format(e='t.epoch')} AS policy_floor, t.epoch_mc AS estimated_mc, t.thr AS comparison_threshold, t.epoch_n::BIGINT AS epoch_event_count,
  coalesce(m.n, 0)::BIGINT AS epoch_magnitude_count FROM thr t LEFT JOIN emc m USING (dom, epoch)"""
    out["completeness_by_domain"] = f"""
WITH {ORDERS}, kept AS (SELECT * FROM cat WHERE pref), {mc('kept', 'dom', 50, 'd')}
SELECT dom AS tectonic_domain, n::BIGINT AS event_count, mc, n >= 50 AS sufficient_data FROM d"""
    out["completeness_by_decade"] = f"""
WITH {EVENTS}, dec AS (SELECT dom, (1900 + id % 40 * 10)::INT AS decade, mag FROM cat), {mc('dec', 'dom,decade', 50, 'd')},
every AS (SELECT DISTINCT dom, decade FROM dec)
SELECT e.dom AS tectonic_domain, e.decade AS epoch_start_year, d.mc AS catalogue_completeness_mc, coalesce(d.n, 0)::BIGINT AS completeness_event_count,
  coalesce(d.n >= 50, false) AS completeness_sufficient_data FROM every e LEFT JOIN d USING (dom, decade)"""
    out["fixed_completeness"] = f"""
WITH {EVENTS}, {mc('cat', '', 50, 'd')} SELECT mc, n::BIGINT AS event_count FROM d"""
    groups = f"""
{EVENTS},
e AS (SELECT a.id AS a, b.id AS b FROM cat a JOIN cat b ON a.id <> b.id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 90000000
  AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 35 AND (a.mag IS NULL OR b.mag IS NULL OR abs(a.mag - b.mag) <= 0.6e0)),
reach(id, c) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.id),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
named AS (SELECT c, 'DUP-' || upper(substr(sha1(concat_ws('|', count(*), min(id::VARCHAR), max(id::VARCHAR),
    sum(('0x' || substr(md5(id::VARCHAR), 1, 15))::BIGINT)::VARCHAR, sum(('0x' || substr(md5(id::VARCHAR), 16, 15))::BIGINT)::VARCHAR)), 1, 12)) AS gid FROM comp GROUP BY c),
ranked AS (SELECT m.id, n.gid, row_number() OVER (PARTITION BY m.c ORDER BY
    (CASE k.source WHEN 'IPMA' THEN 5 WHEN 'ISC' THEN 4 WHEN 'AHEAD' THEN 3 ELSE 0 END) DESC,
    (CASE k.rstatus WHEN 'reviewed' THEN 3 WHEN 'preliminary' THEN 1 ELSE 0 END) DESC,
    ((k.depth IS NOT NULL)::INT + (k.mag IS NOT NULL)::INT + (k.mtype IS NOT NULL)::INT + 1) DESC, k.q DESC, k.ts, k.id::VARCHAR) AS r
  FROM comp m JOIN named n USING (c) JOIN cat k ON k.id = m.id)"""
    out["duplicate_groups"] = f"""
WITH RECURSIVE {groups}
SELECT c.id::VARCHAR AS event_id, r.gid AS duplicate_group_id, coalesce(r.r = 1, true) AS is_preferred_record FROM cat c LEFT JOIN ranked r USING (id)"""
    out["declustered_catalogue"] = f"""
WITH RECURSIVE {EVENTS}, {sequences("cat", "true")}
SELECT c.id::VARCHAR AS event_id, {SEQUENCE_ID} AS cluster_id, {SEQUENCE_ROLE} AS cluster_role,
  {SEQUENCE_ROLE} IN ('background', 'mainshock') AS is_background_event
FROM cat c LEFT JOIN eq ON eq.id = c.id LEFT JOIN claim k ON k.id = c.id LEFT JOIN main m ON m.id = c.id LEFT JOIN main o ON o.id = k.owner"""
    out["declustering_counts"] = f"""
WITH RECURSIVE {EVENTS}, {sequences("cat", "true")}, roles AS (
  SELECT {SEQUENCE_ROLE} AS r, {SEQUENCE_ID} AS s, eq.id IS NOT NULL AS ok
  FROM cat c LEFT JOIN eq ON eq.id = c.id LEFT JOIN claim k ON k.id = c.id LEFT JOIN main m ON m.id = c.id LEFT JOIN main o ON o.id = k.owner),
n AS (SELECT count(*) AS n, count(*) FILTER (ok) AS ok, count(*) FILTER (r IN ('background', 'mainshock')) AS bg, count(*) FILTER (r = 'associated_event') AS a,
  count(*) FILTER (r = 'mainshock') AS m, count(*) FILTER (r = 'ineligible') AS i, count(DISTINCT s) AS q FROM roles)
SELECT n AS preferred_events, ok AS eligible_events, bg AS background_events, a AS associated_events, m AS mainshocks, i AS ineligible_events, 0::BIGINT AS unclassified_events,
  bg + a + i AS reconciled_events, n - bg - a - i AS reconciliation_gap, q AS sequences, round(bg/n::DOUBLE, 6) AS retained_fraction, round(bg/ok::DOUBLE, 6) AS retained_fraction_eligible,
  '{DECLUSTER_METHOD}' AS method FROM n"""
    out["declustering_exclusions"] = f"""
WITH {EVENTS} SELECT 'missing_magnitude' AS reason, count(*)::BIGINT AS records FROM cat WHERE mag IS NULL HAVING count(*) > 0"""
    out["harmonised_catalogue"] = f"""
WITH RECURSIVE {groups}, kept AS (
  SELECT c.*, r.gid, coalesce(r.r = 1, true) AS pref FROM cat c LEFT JOIN ranked r USING (id)),
{sequences("kept", "pref")}, {placed}
SELECT c.id::VARCHAR AS event_id, {region} AS tectonic_domain, c.gid AS duplicate_group_id, c.pref AS is_preferred_record,
  CASE WHEN NOT c.pref THEN 'redundant_record' ELSE {SEQUENCE_ROLE} END AS cluster_role,
  CASE WHEN c.mag IS NULL THEN 'missing' WHEN c.mtype = 'Mw' THEN 'reviewed_identity' WHEN c.mtype = 'ML' THEN 'review_required' ELSE 'unknown_scale' END AS magnitude_homogenization_status
FROM kept c JOIN per USING (lat, lon) LEFT JOIN eq ON eq.id = c.id LEFT JOIN claim k ON k.id = c.id LEFT JOIN main m ON m.id = c.id LEFT JOIN main o ON o.id = k.owner"""
    out["consolidation"] = f"""
WITH RECURSIVE {groups}, f AS (SELECT r.gid, coalesce(r.r = 1, true) AS pref FROM cat c LEFT JOIN ranked r USING (id))
SELECT count(*)::BIGINT AS raw_records, count(*) FILTER (pref)::BIGINT AS consolidated_events, count(*) FILTER (NOT pref)::BIGINT AS redundant_records,
  count(DISTINCT gid)::BIGINT AS duplicate_groups, round(count(*) FILTER (NOT pref)/count(*)::DOUBLE, 6) AS consolidation_rate FROM f"""
    out["keep_last_per_key"] = """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""
    out["union_catalogues"] = f"""
SELECT source, count(*)::BIGINT AS events, count(mag)::BIGINT AS with_magnitude FROM (
  SELECT source, mag FROM (WITH {ORDERS} SELECT * FROM cat) UNION ALL SELECT source, mag FROM (WITH {EVENTS} SELECT * FROM cat)) GROUP BY 1"""
    out["target_asof"] = f"""
WITH {feat90}, q AS (SELECT dom, max(we) - 200 AS cut FROM feat GROUP BY dom)
SELECT dom AS tectonic_domain, max(we)::VARCHAR AS target_end, arg_max(n, we)::BIGINT AS event_count FROM q JOIN feat USING (dom) WHERE we <= cut GROUP BY dom"""
    exp = "coalesce(exp(-abs(h.{c} - t.{c})/{s}), {d})"
    cov = "+".join(f"(CASE WHEN h.{c} - t.{c} IS NULL THEN 0.65e0 ELSE greatest(0.05e0, least(1e0, 1 - abs(h.{c} - t.{c}))) END)" for c in ("mag_cov", "depth_cov", "loc_cov"))
    shares = ("s_ipma", "s_isc", "s_ahead", "s_other")
    dot, nh, nt = (
        "+".join(f"{a}.{c}*{b}.{c}" for c in shares) for a, b in (("h", "t"), ("h", "h"), ("t", "t"))
    )
    out["comparability_scores"] = f"""
WITH {feat90}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY we DESC) AS r FROM feat) WHERE r = 1),
s AS (SELECT h.dom, h.we, {exp.format(c='quality', s='0.18e0', d='0.6e0')} AS a, {exp.format(c='mc', s='0.65e0', d='0.55e0')} AS b,
  {exp.format(c='thr', s='0.5e0', d='0.5e0')} AS c, ({cov})/3 AS d,
  CASE WHEN sqrt({nt}) = 0 THEN 0.5e0 ELSE greatest(0.05e0, least(1e0, CASE WHEN sqrt({nh})*sqrt({nt}) > 0 THEN ({dot})/(sqrt({nh})*sqrt({nt})) ELSE 0 END)) END AS e
  FROM feat h JOIN t ON t.dom = h.dom AND h.we <= t.we - 365 AND h.epoch = t.epoch)
SELECT dom AS tectonic_domain, we::VARCHAR AS window_end, round(a,6) AS quality_compatibility, round(b,6) AS completeness_compatibility,
  round(c,6) AS threshold_compatibility, round(d,6) AS coverage_compatibility, round(e,6) AS source_profile_compatibility,
  round(greatest(0.05e0, least(1e0, exp(0.2e0*ln(greatest(a,0.05e0)) + 0.2e0*ln(greatest(b,0.05e0)) + 0.15e0*ln(greatest(c,0.05e0))
   + 0.2e0*ln(greatest(d,0.05e0)) + 0.25e0*ln(greatest(e,0.05e0))))),6) AS comparability_score FROM s"""
    names = {
        "comparable_event_count": "cn", "comparable_event_rate_per_30d": "crate", "maximum_magnitude": "mx",
        "mean_magnitude": "mean_m", "median_depth_km": "med_depth", "depth_std_km": "sd_depth",
        "spatial_dispersion_km": "disp", "log10_total_energy_j": "energy", "days_since_previous_m3": "since",
        "catalogue_completeness_mc": "mc", "data_quality_score": "quality",
    }
    stacked = ", ".join(f"('{n}', h.{c}::DOUBLE, t.{c}::DOUBLE)" for n, c in names.items())
    scaling = f"""{feat90}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY we DESC) AS r FROM feat) WHERE r = 1),
l AS (SELECT h.dom, h.we, v.* FROM feat h JOIN t ON t.dom = h.dom AND h.we <= t.we - 365 AND h.epoch = t.epoch,
  LATERAL (VALUES {stacked}) v(f, x, tx)),
u AS (SELECT dom, f, median(x) AS med FROM l GROUP BY dom, f HAVING count(x) >= 3 AND min(x) < max(x)),
i AS (SELECT l.dom, l.we, l.f, coalesce(x, med) AS x, coalesce(tx, med) AS tx FROM l JOIN u USING (dom, f)),
b AS (SELECT dom, f, CASE WHEN same THEN mn ELSE ql END AS lo, CASE WHEN same THEN mx ELSE qh END AS hi FROM (
  SELECT *, abs(ql - qh) <= 1e-8 + 1e-5*abs(qh) AS same FROM (
    SELECT dom, f, quantile_cont(x, 0.025) AS ql, quantile_cont(x, 0.975) AS qh, min(x) AS mn, max(x) AS mx FROM i GROUP BY dom, f))),
k AS (SELECT dom, we, f, least(greatest(x, lo), hi) AS x, least(greatest(tx, lo), hi) AS tx FROM i JOIN b USING (dom, f)),
sc AS (SELECT dom, f, median(x) AS c, (CASE WHEN q9 - q1 < 2.3e-15 THEN 1 ELSE q9 - q1 END)/2.5631031310892007e0 AS s FROM (
  SELECT dom, f, x, quantile_cont(x, 0.1) OVER (PARTITION BY dom, f) AS q1, quantile_cont(x, 0.9) OVER (PARTITION BY dom, f) AS q9 FROM k) GROUP BY dom, f, q1, q9),
z AS (SELECT dom, we, f, greatest(-6e0, least(6e0, (x - c)/s)) AS z, greatest(-6e0, least(6e0, (tx - c)/s)) AS tz FROM k JOIN sc USING (dom, f))"""
    out["robust_scaling"] = f"""
WITH {scaling} SELECT dom AS tectonic_domain, we::VARCHAR AS window_end, f AS feature, round(z, 5) AS z, round(tz, 5) AS target_z FROM z"""
    weights = " ".join(
        f"WHEN '{n}' THEN {w}e0" for n, w in {
            "comparable_event_count": "1.0", "comparable_event_rate_per_30d": "1.1", "maximum_magnitude": "1.15",
            "mean_magnitude": "0.85", "median_depth_km": "0.7", "depth_std_km": "0.6", "spatial_dispersion_km": "0.85",
            "log10_total_energy_j": "1.0", "days_since_previous_m3": "0.7", "catalogue_completeness_mc": "0.7",
            "data_quality_score": "0.55"}.items())
    out["weighted_distance"] = f"""
WITH {scaling}, wt AS (SELECT dom, f, CASE f {weights} END AS w FROM u), wn AS (SELECT dom, f, w/avg(w) OVER (PARTITION BY dom) AS w FROM wt)
SELECT dom AS tectonic_domain, we::VARCHAR AS window_end, round(sqrt(sum((z - tz)*(z - tz)*w)), 5) AS raw_distance
FROM z JOIN wn USING (dom, f) GROUP BY dom, we"""
    comparable = f"""
cs AS (SELECT h.dom, h.we, {exp.format(c='quality', s='0.18e0', d='0.6e0')} AS a, {exp.format(c='mc', s='0.65e0', d='0.55e0')} AS b,
  {exp.format(c='thr', s='0.5e0', d='0.5e0')} AS c, ({cov})/3 AS d,
  CASE WHEN sqrt({nt}) = 0 THEN 0.5e0 ELSE greatest(0.05e0, least(1e0, CASE WHEN sqrt({nh})*sqrt({nt}) > 0 THEN ({dot})/(sqrt({nh})*sqrt({nt})) ELSE 0 END)) END AS e
  FROM feat h JOIN t ON t.dom = h.dom AND h.we <= t.we - 365 AND h.epoch = t.epoch),
comp AS (SELECT dom, we, greatest(0.05e0, least(1e0, exp(0.2e0*ln(greatest(a,0.05e0)) + 0.2e0*ln(greatest(b,0.05e0)) + 0.15e0*ln(greatest(c,0.05e0))
   + 0.2e0*ln(greatest(d,0.05e0)) + 0.25e0*ln(greatest(e,0.05e0))))) AS score FROM cs)"""
    # Families are all windows that end within half the radius (720 / 2 days);
    # five are picked by distance, whose intervals keep 90 days apart.
    weighted = f"""{scaling}, wt AS (SELECT dom, f, CASE f {weights} END AS w FROM u), wn AS (SELECT dom, f, w/avg(w) OVER (PARTITION BY dom) AS w FROM wt),
euclid AS (SELECT dom, we, sqrt(sum((z - tz)*(z - tz)*w)) AS raw FROM z JOIN wn USING (dom, f) GROUP BY dom, we)"""
    measured = f"""{comparable},
enough AS (SELECT dom FROM raw GROUP BY dom HAVING count(*) >= 5 AND dom IN (SELECT dom FROM u GROUP BY dom HAVING count(*) >= 2)),
m AS (SELECT raw.*, score, raw/greatest(0.2e0, least(1e0, score)) AS adj FROM raw JOIN comp USING (dom, we) SEMI JOIN enough USING (dom)),
sim AS (SELECT m.*, exp(-adj/greatest(median(adj) OVER (PARTITION BY dom), 1e-6)) AS sim FROM m)"""
    fixed = "fam AS (SELECT a.dom, a.we, min(b.we - 89) AS fs, max(b.we) AS fe, count(*) AS n FROM m a JOIN m b ON a.dom = b.dom AND abs(a.we - b.we) <= 360 GROUP BY 1, 2)"
    picked = """
ranked AS (SELECT sim.*, fs, fe, n, row_number() OVER (PARTITION BY dom ORDER BY adj, we) AS i FROM sim JOIN fam USING (dom, we)),
pick(dom, i, ch) AS (SELECT DISTINCT dom, 0::BIGINT, []::STRUCT(fs DATE, fe DATE, i BIGINT)[] FROM ranked UNION ALL
  SELECT p.dom, r.i, CASE WHEN len(ch) >= 5 OR len(list_filter(ch, lambda x: r.fs <= x.fe + 90 AND r.fe >= x.fs - 90)) > 0 THEN ch
    ELSE list_append(ch, {'fs': r.fs, 'fe': r.fe, 'i': r.i}) END FROM pick p JOIN ranked r ON r.dom = p.dom AND r.i = p.i + 1),
best AS (SELECT dom, arg_max(ch, i) AS ch FROM pick GROUP BY dom),
near AS (SELECT r.*, x.k AS rank, strftime(fs, '%Y%m%d') || '-' || strftime(fe, '%Y%m%d') AS fid, 'EPI-' || strftime(we, '%Y%m%d') AS eid
  FROM (SELECT dom, unnest(ch).i AS i, unnest(generate_series(1, len(ch))) AS k FROM best) x JOIN ranked r ON r.dom = x.dom AND r.i = x.i)"""
    neighbours = f"{weighted}, raw AS (SELECT * FROM euclid), {measured}, {fixed}, {picked}"
    # The covariance is inverted by Gauss-Jordan elimination, one pivot a step.
    inverted = """
uw AS (SELECT dom, we, f, z*sqrt(w) AS uu, (z - tz)*sqrt(w) AS d, dense_rank() OVER (PARTITION BY dom ORDER BY f) AS i FROM z JOIN wn USING (dom, f)),
co AS (SELECT a.dom, a.i, b.i AS j, covar_samp(a.uu, b.uu) + CASE WHEN a.i = b.i THEN 1e-6 ELSE 0 END AS c FROM uw a JOIN uw b ON a.dom = b.dom AND a.we = b.we GROUP BY a.dom, a.i, b.i),
mr AS (SELECT dom, i, list(c ORDER BY j) AS r, count(*) AS p FROM co GROUP BY dom, i),
mq AS (SELECT dom, i, p, list_concat(r, list_transform(range(1, p + 1), lambda q: CASE WHEN q = i THEN 1e0 ELSE 0e0 END)) AS r FROM mr),
gj(dom, k, p, mat) AS (
  SELECT dom, 1::BIGINT, any_value(p), list(r ORDER BY i) FROM mq GROUP BY dom
  UNION ALL SELECT dom, k + 1, p, list_transform(range(1, p + 1), lambda x: list_transform(range(1, 2*p + 1), lambda y:
    CASE WHEN x = k THEN mat[k][y]/mat[k][k] ELSE mat[x][y] - mat[x][k]*mat[k][y]/mat[k][k] END)) FROM gj WHERE k <= p),
inv AS (SELECT dom, p, mat FROM gj WHERE k = p + 1),
sq AS (SELECT a.dom, a.we, sum(a.d*b.d*mat[a.i][p + b.i]) AS q, any_value(p) AS n_f FROM uw a JOIN uw b USING (dom, we) JOIN inv USING (dom) GROUP BY 1, 2),
raw AS (SELECT dom, we, CASE WHEN count(*) OVER (PARTITION BY dom) > n_f + 2 THEN sqrt(greatest(0e0, q)) ELSE e.raw END AS raw FROM sq JOIN euclid e USING (dom, we))"""
    # Regimes end at a gap over 240 days, a jump of 3.5 robust deviations, or a span over 720 days.
    adaptive = """
rl AS (SELECT m.dom, m.we, row_number() OVER (PARTITION BY m.dom, v.f ORDER BY m.we) AS pos, v.* FROM m JOIN feat x USING (dom, we),
  LATERAL (VALUES ('a', x.crate::DOUBLE), ('b', x.mx::DOUBLE), ('c', x.energy::DOUBLE), ('d', x.disp::DOUBLE)) v(f, y)),
re AS (SELECT *, last_value(y IGNORE NULLS) OVER bw AS b_y, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER bw AS bp,
    first_value(y IGNORE NULLS) OVER fw AS ay, first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER fw AS ap FROM rl
  WINDOW bw AS (PARTITION BY dom, f ORDER BY we ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), fw AS (PARTITION BY dom, f ORDER BY we ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
rf AS (SELECT dom, we, f, pos, coalesce(y, b_y + (ay - b_y)/nullif(ap - bp, 0)*(pos - bp), ay, b_y, 0) AS y FROM re),
rd AS (SELECT *, y - lag(y) OVER (PARTITION BY dom, f ORDER BY we) AS dy FROM rf),
rc AS (SELECT dom, f, median(dy) AS c, stddev_pop(dy) AS sd FROM rd GROUP BY dom, f),
rm AS (SELECT dom, f, median(abs(dy - c)) AS mad FROM rd JOIN rc USING (dom, f) GROUP BY dom, f),
rs AS (SELECT dom, we, pos, max(abs((dy - c)/CASE WHEN mad > 1e-9 THEN mad*1.4826e0 WHEN sd > 1e-9 THEN sd ELSE 1 END)) AS jump FROM rd JOIN rc USING (dom, f) JOIN rm USING (dom, f) GROUP BY 1, 2, 3),
rb AS (SELECT *, coalesce(we - lag(we) OVER (PARTITION BY dom ORDER BY we) > 240 OR jump >= 3.5, true) AS new FROM rs),
rn(dom, pos, g, begun) AS (SELECT dom, 1::BIGINT, 0, we FROM rb WHERE pos = 1 UNION ALL
  SELECT n.dom, b.pos, CASE WHEN b.new OR b.we - begun > 720 THEN g + 1 ELSE g END, CASE WHEN b.new OR b.we - begun > 720 THEN b.we ELSE begun END
  FROM rn n JOIN rb b ON b.dom = n.dom AND b.pos = n.pos + 1),
rg AS (SELECT rb.dom, rb.we, g FROM rn JOIN rb USING (dom, pos)),
fam AS (SELECT * EXCLUDE (o) FROM (SELECT m.dom, m.we, min(m.we - 89) OVER w AS fs, max(m.we) OVER w AS fe, count(*) OVER w AS n, row_number() OVER (PARTITION BY m.dom, g ORDER BY adj, m.we) AS o
  FROM m JOIN rg USING (dom, we) WINDOW w AS (PARTITION BY m.dom, g)) WHERE o = 1)"""
    out["main_contributions"] = f"""
WITH RECURSIVE {neighbours}, d AS (SELECT n.dom, n.rank, n.we, n.eid, n.fid, z.f, abs(z - tz) AS a, abs(z - tz)*w AS b
  FROM near n JOIN z ON z.dom = n.dom AND z.we = n.we JOIN wn ON wn.dom = n.dom AND wn.f = z.f),
o AS (SELECT d.*, CASE WHEN sum(b) OVER v > 0 THEN b/sum(b) OVER v*100 ELSE 0 END AS pct FROM d WINDOW v AS (PARTITION BY dom, we))
SELECT o.rank::INT AS analogue_rank, o.we::VARCHAR AS neighbour_window_end, o.eid AS episode_id, 'FAM-' || o.fid AS family_id, o.f AS feature, round(l.tx, 5) AS target_value, round(l.x, 5) AS neighbour_value,
  round(a, 5) AS robust_absolute_difference, round(b, 5) AS weighted_difference, round(pct, 5) AS contribution_pct
FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY dom, we ORDER BY pct DESC, f) <= 3) o JOIN l ON l.dom = o.dom AND l.we = o.we AND l.f = o.f"""
    out["nearest_states_adaptive_mahalanobis"] = f"""
WITH RECURSIVE {weighted}, {inverted}, {measured}, {adaptive}, {picked}
SELECT dom AS tectonic_domain, rank::INT AS analogue_rank, we::VARCHAR AS window_end, 'REG-' || fid AS family_id, eid AS episode_id, n::BIGINT AS family_window_count,
  round(raw, 5) AS raw_distance, round(score, 5) AS comparability_score, round(adj, 5) AS adjusted_distance, round(sim, 5) AS similarity FROM near"""
    out["nearest_states_fixed"] = f"""
WITH RECURSIVE {neighbours} SELECT dom AS tectonic_domain, rank::INT AS analogue_rank, we::VARCHAR AS window_end, 'FAM-' || fid AS family_id, eid AS episode_id, n::BIGINT AS family_window_count,
  round(raw, 5) AS raw_distance, round(score, 5) AS comparability_score, round(adj, 5) AS adjusted_distance, round(sim, 5) AS similarity FROM near"""
    out["similarity_explanations"] = f"""
WITH RECURSIVE {neighbours}, d AS (SELECT n.dom, n.rank, n.we, n.eid, n.fid, z.f, abs(z - tz) AS a, abs(z - tz)*w AS b
  FROM near n JOIN z ON z.dom = n.dom AND z.we = n.we JOIN wn ON wn.dom = n.dom AND wn.f = z.f)
SELECT d.rank::INT AS analogue_rank, d.we::VARCHAR AS neighbour_window_end, d.eid AS episode_id, 'FAM-' || d.fid AS family_id, d.f AS feature, round(l.tx, 5) AS target_value, round(l.x, 5) AS neighbour_value,
  round(a, 5) AS robust_absolute_difference, round(b, 5) AS weighted_difference,
  round(CASE WHEN sum(b) OVER (PARTITION BY d.dom, d.we) > 0 THEN b/sum(b) OVER (PARTITION BY d.dom, d.we)*100 ELSE 0 END, 5) AS contribution_pct
FROM d JOIN l ON l.dom = d.dom AND l.we = d.we AND l.f = d.f"""
    out["future_outcomes"] = f"""
WITH {feat90}, ok AS (SELECT * FROM cat WHERE pref), s(thr0, h) AS (VALUES {SCENARIOS})
SELECT f.dom AS tectonic_domain, f.we::VARCHAR AS window_end, s.thr0 AS threshold_magnitude, s.h AS horizon_days,
  EXISTS (SELECT 1 FROM ok e WHERE e.dom = f.dom AND e.mag >= s.thr0 AND e.ts > f.we::TIMESTAMP AND e.ts <= f.we::TIMESTAMP + to_days(s.h::INT)) AS outcome
FROM feat f, s"""
    out["replay_baselines"] = f"""
WITH {ORDERS}, ok AS (SELECT *, {EPOCH.format(y='year(ts)')} AS epoch FROM cat WHERE pref),
c AS (SELECT DISTINCT dom, date_trunc('quarter', ts) + INTERVAL 1 DAY AS cut FROM ok),
s(thr0, h) AS (VALUES {SCENARIOS}),
x AS (SELECT c.dom, cut, {EPOCH.format(y='year(cut)')} AS epoch FROM c),
f AS (SELECT x.*, (SELECT min(ts)::DATE::TIMESTAMP FROM ok WHERE ok.dom = x.dom AND ok.epoch = x.epoch AND ts <= cut) AS t0 FROM x),
g AS (SELECT f.*, s.*, coalesce(greatest(0, epoch_us(cut) - epoch_us(t0))/86400e6, 0) AS expo FROM f, s),
k AS (SELECT *, floor(expo/h)::BIGINT AS wn FROM g),
j AS (SELECT k.dom, k.cut, k.thr0, k.h, count(*) AS n, count(DISTINCT CASE WHEN wn > 0 AND off > 0 AND off <= wn*h THEN least(wn - 1, floor(off/h)) END) AS pos
  FROM k JOIN ok e ON e.dom = k.dom AND e.epoch = k.epoch AND e.ts <= k.cut AND e.mag >= k.thr0,
  LATERAL (SELECT (epoch_us(e.ts) - (epoch_us(k.cut) - wn*h*86400000000))/86400e6 AS off) o GROUP BY 1, 2, 3, 4)
SELECT k.dom AS tectonic_domain, k.cut::DATE::VARCHAR AS cutoff, k.thr0 AS threshold_magnitude, k.h AS horizon_days, k.epoch AS baseline_epoch,
  coalesce(j.n, 0)::BIGINT AS baseline_event_count, round(expo, 6) AS baseline_exposure_days, wn AS empirical_window_count, coalesce(j.pos, 0)::BIGINT AS empirical_positive_windows,
  round(CASE WHEN wn > 0 THEN coalesce(j.pos, 0)/wn::DOUBLE ELSE 0 END, 6) AS historical_rate_probability,
  round(CASE WHEN expo > 0 THEN 1 - exp(-coalesce(j.n, 0)/expo*k.h) ELSE 0 END, 6) AS poisson_probability
FROM k LEFT JOIN j USING (dom, cut, thr0, h)"""
    b5 = CAL_BIN.format(b=5)
    lo, hi = wilson("pos/n::DOUBLE", "n")
    out["calibration_bins"] = f"""
WITH {SCORES}, g AS (SELECT model, {b5} AS bin, p, o FROM scores), a AS (SELECT model, bin, avg(p) AS mp, count(*) AS n, sum(o) AS pos FROM g GROUP BY 1, 2)
SELECT model, bin::INT AS bin, round(mp, 6) AS mean_probability, round(pos/n::DOUBLE, 6) AS observed_frequency, round({lo}, 6) AS ci_lower,
  round({hi}, 6) AS ci_upper, n::BIGINT AS cutoffs, pos::BIGINT AS positives FROM a"""
    out["calibration_error"] = f"""
WITH {SCORES}, g AS (SELECT model, {CAL_BIN.format(b=10)} AS bin, p, o FROM scores), a AS (SELECT model, bin, avg(p) AS mp, count(*) AS n, avg(o) AS mo FROM g GROUP BY 1, 2)
SELECT model, round(sum(n*abs(mp - mo))/sum(n), 6) AS expected_calibration_error FROM a GROUP BY model"""
    out["classification"] = f"""
WITH {SCORES}, t(th) AS (VALUES (0.005e0), (0.01e0), (0.02e0), (0.05e0), (0.1e0)),
a AS (SELECT model, th, count(*) FILTER (p >= th AND o = 1) AS tp, count(*) FILTER (p >= th AND o = 0) AS fp,
  count(*) FILTER (p < th AND o = 0) AS tn, count(*) FILTER (p < th AND o = 1) AS fn FROM scores, t GROUP BY 1, 2),
r AS (SELECT *, tp/nullif(tp + fp, 0)::DOUBLE AS pr, tp/nullif(tp + fn, 0)::DOUBLE AS re FROM a)
SELECT model, th AS decision_threshold, tp::BIGINT AS true_positives, fp::BIGINT AS false_positives, tn::BIGINT AS true_negatives, fn::BIGINT AS false_negatives,
  round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2*pr*re/(pr + re) END, 6) AS f1,
  round(fp/nullif(fp + tn, 0)::DOUBLE, 6) AS false_alarm_rate FROM r"""
    curve = f"""{SCORES}, d AS (SELECT DISTINCT model, p FROM scores), n AS (SELECT model, sum(o) AS pos, count(*) AS n FROM scores GROUP BY model HAVING sum(o) > 0 AND sum(o) < count(*)),
c AS (SELECT d.model, d.p, sum(s.o) AS tp, count(*) AS fl, sum(CASE WHEN s.p = d.p THEN s.o ELSE 0 END) AS own
  FROM d JOIN scores s ON s.model = d.model AND s.p >= d.p GROUP BY 1, 2),
pr AS (SELECT c.model, c.p, tp/fl::DOUBLE AS pre, tp/pos::DOUBLE AS rec, own/pos::DOUBLE AS step, n.n, n.pos FROM c JOIN n USING (model)),
ap AS (SELECT model, sum(step*pre) AS ap FROM pr GROUP BY model)"""
    out["precision_recall"] = f"""
WITH {curve} SELECT model, p AS threshold, round(pre, 6) AS precision, round(rec, 6) AS recall, n::BIGINT AS cutoffs, pos::BIGINT AS positives, round(ap, 6) AS average_precision
FROM (SELECT model, p, pre, rec, n, pos FROM pr UNION ALL SELECT DISTINCT model, NULL, 1e0, 0e0, n, pos FROM pr) JOIN ap USING (model)"""
    out["model_metrics"] = f"""
WITH {curve}, g AS (SELECT model, {b5} AS bin, p, o FROM scores), a AS (SELECT model, bin, avg(p) AS mp, count(*) AS n, avg(o) AS mo FROM g GROUP BY 1, 2),
e AS (SELECT model, sum(n*abs(mp - mo))/sum(n) AS ece FROM a GROUP BY model)
SELECT s.model, count(*)::BIGINT AS valid_cutoffs, round(avg(s.p), 6) AS mean_probability, round(avg(s.o), 6) AS observed_frequency, round(avg(s.brier), 6) AS mean_brier,
  round(1 - avg(s.brier)/avg(s.be), 6) AS bss_vs_empirical, round(1 - avg(s.brier)/avg(s.bp), 6) AS bss_vs_poisson,
  round(any_value(e.ece), 6) AS expected_calibration_error, round(any_value(ap.ap), 6) AS average_precision
FROM scores s JOIN e USING (model) LEFT JOIN ap USING (model) GROUP BY s.model"""
    # Walk-forward: the same chain per question, a region at a cutoff, in place of a region.
    ask = f"""{feat90}, ends AS (SELECT dom, we, row_number() OVER (PARTITION BY dom ORDER BY we) - 1 AS i, count(*) OVER (PARTITION BY dom) AS n FROM feat),
cuts AS (SELECT dom AS region, last, cut::TIMESTAMP AS cut, dom || '|' || cut::DATE AS dom FROM (
  SELECT dom, max(we) AS last, unnest(generate_series(max(we) FILTER (i = floor((n - 1)*0.4e0))::TIMESTAMP, max(we) - INTERVAL 7 DAY, INTERVAL 20 DAY)) AS cut FROM ends GROUP BY dom)),
featq AS (SELECT f.* REPLACE (q.dom AS dom) FROM feat f JOIN cuts q ON q.region = f.dom AND f.we <= q.cut)"""

    def per_question(text: str) -> str:
        return text.replace("FROM feat h", "FROM featq h").replace("FROM feat)", "FROM featq)").replace("JOIN feat x", "JOIN featq x")

    replayed = f"""{ask}{per_question(weighted[len(feat90):])}, raw AS (SELECT * FROM euclid), {per_question(measured)}, {per_question(adaptive)}, {picked},
ok AS (SELECT *, {EPOCH.format(y='year(ts)')} AS epoch FROM cat WHERE pref), s(thr0, h) AS (VALUES {SCENARIOS}),
an AS (SELECT n.dom, thr0, h, sum(sim*score*hit)/sum(sim*score) AS p FROM (
  SELECT n.*, thr0, h, EXISTS (SELECT 1 FROM ok e WHERE e.dom = q.region AND e.mag >= s.thr0 AND e.ts > n.we::TIMESTAMP AND e.ts <= least(n.we::TIMESTAMP + to_days(s.h::INT), q.cut))::INT AS hit
  FROM near n JOIN cuts q ON q.dom = n.dom, s) n GROUP BY 1, 2, 3),
x AS (SELECT q.*, s.*, {EPOCH.format(y='year(cut)')} AS epoch FROM cuts q, s WHERE q.dom IN (SELECT dom FROM near)),
x0 AS (SELECT x.*, (SELECT min(ts)::DATE::TIMESTAMP FROM ok WHERE ok.dom = x.region AND ok.epoch = x.epoch AND ts <= cut) AS t0 FROM x),
x1 AS (SELECT *, coalesce(greatest(0, epoch_us(cut) - epoch_us(t0))/86400e6, 0) AS expo FROM x0), x2 AS (SELECT *, floor(expo/h)::BIGINT AS wn FROM x1),
x3 AS (SELECT k.dom, k.thr0, k.h, count(*) AS n, count(DISTINCT CASE WHEN wn > 0 AND off > 0 AND off <= wn*h THEN least(wn - 1, floor(off/h)) END) AS pos
  FROM x2 k JOIN ok e ON e.dom = k.region AND e.epoch = k.epoch AND e.ts <= k.cut AND e.mag >= k.thr0,
  LATERAL (SELECT (epoch_us(e.ts) - (epoch_us(k.cut) - wn*h*86400000000))/86400e6 AS off) o GROUP BY 1, 2, 3),
rw AS (SELECT k.region, k.dom, k.cut, k.thr0, k.h, k.epoch, expo, coalesce(j.n, 0) AS n, an.p,
  CASE WHEN wn > 0 THEN coalesce(j.pos, 0)/wn::DOUBLE ELSE 0 END AS pe, CASE WHEN expo > 0 THEN 1 - exp(-coalesce(j.n, 0)/expo*k.h) ELSE 0 END AS pp,
  EXISTS (SELECT 1 FROM ok e WHERE e.dom = k.region AND e.mag >= k.thr0 AND e.ts > k.cut AND e.ts <= k.cut + to_days(k.h::INT))::INT AS o
  FROM x2 k JOIN an USING (dom, thr0, h) LEFT JOIN x3 j USING (dom, thr0, h) WHERE k.cut <= k.last - to_days(k.h::INT)),
lv AS (SELECT a.dom, a.thr0, a.h, b.p AS x, count(*) AS w, sum(b.o) AS y FROM rw a JOIN rw b ON b.region = a.region AND b.thr0 = a.thr0 AND b.h = a.h AND b.cut < a.cut GROUP BY ALL),
en AS (SELECT dom, thr0, h FROM lv GROUP BY ALL HAVING sum(w) >= 30 AND sum(y) > 0 AND sum(y) < sum(w) AND count(*) >= 3),
pf AS (SELECT *, row_number() OVER v AS k, sum(w) OVER v AS cw, sum(y) OVER v AS cy FROM lv SEMI JOIN en USING (dom, thr0, h) WINDOW v AS (PARTITION BY dom, thr0, h ORDER BY x)),
bl AS (SELECT a.dom, a.thr0, a.h, a.k AS a, b.k AS b, b.x, (b.cy - a.cy + a.y)/(b.cw - a.cw + a.w)::DOUBLE AS mean FROM pf a JOIN pf b ON a.dom = b.dom AND a.thr0 = b.thr0 AND a.h = b.h AND b.k >= a.k),
iso AS (SELECT dom, thr0, h, x, max(lowest) AS fit FROM (SELECT *, min(mean) OVER (PARTITION BY dom, thr0, h, a ORDER BY b DESC) AS lowest FROM bl) GROUP BY 1, 2, 3, 4),
kn AS (SELECT rw.dom, rw.thr0, rw.h, rw.p, max(i.x) FILTER (i.x <= p) AS x0, arg_max(fit, i.x) FILTER (i.x <= p) AS f0, min(i.x) FILTER (i.x >= p) AS x1, arg_min(fit, i.x) FILTER (i.x >= p) AS f1
  FROM rw JOIN iso i USING (dom, thr0, h) GROUP BY ALL),
cal AS (SELECT dom, thr0, h, CASE WHEN x0 IS NULL THEN f1 WHEN x1 IS NULL OR x1 = x0 THEN f0 ELSE f0 + (f1 - f0)*(p - x0)/(x1 - x0) END AS pc FROM kn),
done AS (SELECT rw.*, pc FROM rw LEFT JOIN cal USING (dom, thr0, h))"""
    out["walk_forward_scores"] = f"""
WITH RECURSIVE {replayed} SELECT region AS tectonic_domain, cut::DATE::VARCHAR AS cutoff, round(p, 5) AS analogue_probability, round(pe, 5) AS historical_rate_probability, round(pp, 5) AS poisson_probability,
  o = 1 AS observed_outcome, round(pow(p - o, 2), 5) AS brier_analogue, round(pow(pe - o, 2), 5) AS brier_historical, round(pow(pp - o, 2), 5) AS brier_poisson, {LABEL.format(e='epoch')} AS baseline_epoch,
  n::BIGINT AS baseline_event_count, round(expo, 5) AS baseline_exposure_days, thr0::DOUBLE AS threshold_magnitude, h AS horizon_days, 'complete' AS catalogue_mode, 'operational' AS magnitude_policy,
  'adaptive' AS family_method, round(pc, 5) AS analogue_calibrated_probability, round(pow(pc - o, 2), 5) AS brier_analogue_calibrated FROM done"""
    rolled = f"""scores AS (SELECT region || '|' || thr0::DOUBLE || '|' || h || '|' || v.model AS model, o, round(v.p, 9) AS p, pow(v.p - o, 2) AS brier, pow(pe - o, 2) AS be, pow(pp - o, 2) AS bp
  FROM done, LATERAL (VALUES ('{MODELS[0][0]}', done.p), ('{MODELS[1][0]}', pc), ('{MODELS[2][0]}', pe), ('{MODELS[3][0]}', pp)) v(model, p) WHERE v.p IS NOT NULL)"""
    metrics = out["model_metrics"].strip().removeprefix("WITH ").replace(SCORES.strip(), rolled, 1)
    cut_at = metrics.rindex("SELECT s.model, count(*)")
    out["walk_forward_summary"] = f"""
WITH RECURSIVE {replayed}, {metrics[:cut_at].rstrip()}, mm AS ({metrics[cut_at:]}),
st AS (SELECT region, thr0, h, count(*) AS total, sum(o) AS pos, count(pc) AS cc, sum(CASE WHEN pc IS NOT NULL THEN o ELSE 0 END) AS cp FROM done GROUP BY 1, 2, 3)
SELECT region AS tectonic_domain, 'complete' AS catalogue_mode, 'operational' AS magnitude_policy, thr0::DOUBLE AS threshold_magnitude, h AS horizon_days, split_part(mm.model, '|', 4) AS model,
  mm.* EXCLUDE (model) REPLACE (CASE WHEN bss_vs_empirical < -1000 THEN -1000 ELSE bss_vs_empirical END AS bss_vs_empirical, CASE WHEN bss_vs_poisson < -1000 THEN -1000 ELSE bss_vs_poisson END AS bss_vs_poisson), total::BIGINT AS total_cutoffs, pos::BIGINT AS positives, cc::BIGINT AS calibrated_cutoffs, cp::BIGINT AS calibrated_positives,
  CASE WHEN cc = 0 THEN 'unavailable' WHEN cc < 30 OR cp < 5 THEN 'experimental' ELSE 'adequate' END AS calibration_status
FROM mm JOIN st ON split_part(mm.model, '|', 1) = st.region AND split_part(mm.model, '|', 2)::DOUBLE = st.thr0 AND split_part(mm.model, '|', 3)::INT = st.h"""
    out["skill_pivot"] = """
SELECT th AS threshold_magnitude, round(avg(v) FILTER (h = 7), 6) AS h7, round(avg(v) FILTER (h = 30), 6) AS h30, round(avg(v) FILTER (h = 90), 6) AS h90
FROM (SELECT 3.5 + (l_linenumber % 4)*0.5e0 AS th, CASE l_suppkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 30 ELSE 90 END AS h, l_discount - l_tax AS v FROM lineitem) GROUP BY 1"""
    out["temporal_counts"] = f"WITH {ORDERS} SELECT strftime(ts, '%Y-%m') AS period, count(*)::BIGINT AS events FROM cat GROUP BY 1"
    out["temporal_counts_long"] = f"""
WITH {ORDERS} SELECT (1000 + id % 1000)::VARCHAR AS period, count(*)::BIGINT AS events FROM cat GROUP BY 1"""
    out["calendar_span"] = f"WITH {ORDERS} SELECT max(year(ts))::INT - min(year(ts))::INT AS calendar_span_years FROM cat"
    out["fractional_date"] = f"""
WITH {ORDERS}, r AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM cat)
SELECT ts::DATE::VARCHAR AS day FROM r WHERE i = floor((n - 1)*0.4e0)"""
    out["source_table"] = f"""
WITH {ORDERS} SELECT source, count(*)::BIGINT AS events, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day, round(avg(q), 6) AS mean_quality
FROM cat WHERE pref GROUP BY 1"""
    out["source_status"] = f"""
WITH {ORDERS}, c AS (SELECT source, count(*) AS n, count(*) FILTER (pref) AS k, max(ts) AS last FROM cat GROUP BY 1), s(source, label) AS (VALUES ('IPMA','IPMA'), ('AHEAD','AHEAD / EPICA'), ('ISC','ISC'))
SELECT label AS source, CASE WHEN coalesce(k,0) > 0 THEN 'Integrada' WHEN coalesce(n,0) > 0 THEN 'Presente no Silver' ELSE 'Não recolhida' END AS state,
  coalesce(n,0)::BIGINT AS silver_records, coalesce(k,0)::BIGINT AS consolidated_events, coalesce(strftime(last, '%d/%m/%Y %H:%M UTC'), '—') AS last_event,
  CASE WHEN coalesce(k,0) > 0 THEN 'Nenhuma' WHEN coalesce(n,0) > 0 THEN 'Rever preferência/deduplicação' ELSE 'Executar ingestão' END AS next_action
FROM s LEFT JOIN c USING (source)"""
    out["counts_by_domain"] = f"WITH {ORDERS} SELECT dom AS tectonic_domain, count(*)::BIGINT AS events FROM cat WHERE pref GROUP BY 1"
    out["magnitude_histogram"] = f"""
WITH {EVENTS}, v AS (SELECT mag FROM cat WHERE mag BETWEEN -3 AND 10.5), s AS (SELECT min(mag) AS lo, (max(mag) - min(mag))/28 AS w FROM v)
SELECT least(27, floor((mag - lo)/w))::INT AS bin, round(lo + least(27, floor((mag - lo)/w))*w, 6) AS bin_start, count(*)::BIGINT AS events FROM v, s GROUP BY 1, 2"""
    out["latest_fingerprints"] = f"""
WITH {feat} SELECT dom AS tectonic_domain, w AS window_days, max(we)::VARCHAR AS window_end, arg_max(n, we)::BIGINT AS event_count, round(arg_max(crate, we), 6) AS comparable_rate
FROM feat GROUP BY 1, 2"""
    out["epoch_table"] = f"""
WITH {feat} SELECT epoch AS comparison_epoch, thr AS comparison_magnitude_threshold, min(we)::VARCHAR AS first_window, max(we)::VARCHAR AS last_window,
  count(*)::BIGINT AS windows, round(median(mc), 6) AS median_mc FROM feat GROUP BY 1, 2"""
    out["current_window"] = f"""
WITH {ORDERS} SELECT id::VARCHAR AS event_id FROM cat WHERE ts >= (SELECT max(ts) FROM cat) - INTERVAL 90 DAY"""
    out["activity_states"] = """
SELECT vec_id, CASE WHEN vec_id % 23 = 0 THEN 'Inconclusivo — referência insuficiente' WHEN eff < 5 THEN 'Inconclusivo — amostra efetiva reduzida'
  WHEN lo >= 0.95 THEN 'Elevação excecional robusta' WHEN lo >= 0.8 THEN 'Atividade elevada com suporte estatístico'
  WHEN hi < 0.8 THEN 'Sem evidência robusta de elevação' ELSE 'Inconclusivo — intervalo atravessa o limiar' END AS state,
  CASE WHEN p >= 0.95 THEN 'Atividade elevada' WHEN p >= 0.75 THEN 'Em observação' ELSE 'Dentro da linha de base' END AS label
FROM (SELECT vec_id, (vec_id % 101)/100e0 AS p, greatest(0e0, (vec_id % 101)/100e0 - label/100e0) AS lo, least(1e0, (vec_id % 101)/100e0 + label/50e0) AS hi, (vec_id % 12)::DOUBLE AS eff FROM embeddings)"""
    state = "\n  ".join((
        "CASE WHEN p IS NULL OR lo IS NULL OR hi IS NULL OR eff IS NULL THEN ('Inconclusivo — referência insuficiente', '{m}')",
        "WHEN eff < 5 THEN ('Inconclusivo — amostra efetiva reduzida', '{s}') WHEN lo >= 0.95 THEN ('Elevação excecional robusta', '{x}')",
        "WHEN lo >= 0.8 THEN ('Atividade elevada com suporte estatístico', '{e}') WHEN hi < 0.8 THEN ('Sem evidência robusta de elevação', '{b}')",
        "ELSE ('Inconclusivo — intervalo atravessa o limiar', '{c}') END",
    )).format(m=STATE_MISSING[1], s=STATE_SMALL[1], x=STATE_EXCEPTIONAL[1], e=STATE_ELEVATED[1], b=STATE_BASELINE[1], c=STATE_CROSSING[1])
    out["activity_of_latest_windows"] = f"""
WITH {feat90}, {percentile('dom,w,epoch', 'cn', 'c')}, l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dom ORDER BY we DESC) = 1),
h AS (SELECT l.dom, list((f.crate <= l.crate)::INT ORDER BY f.we) AS h, count(*) AS n, greatest(2, least(count(*), any_value(l.ovl))) AS len
  FROM l JOIN feat f ON f.dom = l.dom AND f.epoch = l.epoch AND f.we < l.we WHERE f.crate IS NOT NULL GROUP BY l.dom),
r AS (SELECT dom, r, sum(list_sum(h[beg + 1 : beg + least(len, n - b*len)]))/any_value(n)::DOUBLE AS share FROM (
  SELECT *, ('0x' || substr(md5('42|' || r || '|' || b), 1, 15))::BIGINT % greatest(1, n - len + 1) AS beg
  FROM h, range(0, 800) t(r), LATERAL (SELECT unnest(range(0, (n - 1)//len + 1)) AS b) k WHERE n >= 3) GROUP BY dom, r),
q AS (SELECT dom, quantile_cont(share, 0.025) AS lo, quantile_cont(share, 0.975) AS hi FROM r GROUP BY dom),
v AS (SELECT l.dom, l.we, l.p, l.eff, coalesce(least(l.lo, q.lo), l.lo, q.lo) AS lo, coalesce(greatest(l.hi, q.hi), l.hi, q.hi) AS hi FROM l LEFT JOIN q USING (dom)),
s AS (SELECT *, {state} AS st FROM v)
SELECT 'complete' AS catalogue_mode, 'operational' AS magnitude_policy, dom AS tectonic_domain, 90 AS window_days, we::VARCHAR AS window_end,
  round(p, 6) AS comparable_percentile_event_rate, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper, round(eff, 6) AS comparable_effective_sample_size,
  st[1] AS state, st[2] AS level FROM s"""
    out["map_points"] = f"""
WITH {EVENTS} SELECT id::VARCHAR AS event_id, round(least(46e0, greatest(7e0, pow(mag, 2.15e0)*2.5e0)), 6) AS marker_size,
  '<b>' || dom || '</b><br>Data: ' || strftime(ts, '%Y-%m-%d %H:%M:%S UTC') || '<br>Magnitude: ' || format('{{:.1f}}', round(mag, 1)) || '<br>Profundidade: ' ||
  CASE WHEN depth IS NULL THEN '—' ELSE depth::INT::VARCHAR || '.0 km' END || '<br>Fonte: ' || source || '<br>Coordenadas: ' ||
  format('{{:.3f}}', lat) || ', ' || format('{{:.3f}}', lon) AS hover_text
FROM cat WHERE mag >= 0.5"""
    out["map_strongest"] = f"""
WITH {ORDERS}, p AS (SELECT * FROM cat WHERE mag >= 1) SELECT id::VARCHAR AS event_id, mag AS magnitude_comparable FROM p ORDER BY mag DESC, id::VARCHAR LIMIT 750"""
    out["map_sample"] = f"""
WITH {ORDERS}, p AS (SELECT id::VARCHAR AS event_id, mag AS magnitude_comparable FROM cat WHERE mag >= 1),
top AS (SELECT * FROM p ORDER BY magnitude_comparable DESC, event_id LIMIT 750)
SELECT * FROM top UNION ALL (SELECT * FROM p WHERE event_id NOT IN (SELECT event_id FROM top) ORDER BY md5(event_id), event_id LIMIT 4250)"""
    out["density_grid"] = f"""
WITH {EVENTS}, v AS (SELECT * FROM cat WHERE mag >= 0.5), s AS (SELECT min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM v),
c AS (SELECT greatest(0, least(69, floor((lat - a0)/((a1 - a0)/70))))::INT AS i, greatest(0, least(69, floor((lon - o0)/((o1 - o0)/70))))::INT AS j, * FROM v, s),
g AS (SELECT i, j, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n, max(mag) AS mx, ln(1 + count(*)) AS ld FROM c GROUP BY i, j)
SELECT i AS latitude_bin, j AS longitude_bin, round(lat, 6) AS latitude, round(lon, 6) AS longitude, n::BIGINT AS events, mx AS maximum_magnitude,
  round(ld, 6) AS log_density, round(least(ld, (SELECT greatest(quantile_cont(ld, 0.99), 1e-6) FROM g)), 6) AS display_density,
  round(least(34e0, greatest(8e0, 7 + sqrt(n)*2.8e0)), 6) AS marker_size FROM g"""
    out["map_view"] = f"""
WITH {EVENTS}, v AS (SELECT max(lat) - min(lat) AS a, max(lon) - min(lon) AS o, avg(lat) AS la, avg(lon) AS lo FROM cat WHERE mag >= 0.5)
SELECT round(la, 6) AS center_latitude, round(lo, 6) AS center_longitude,
  round(least(8.5e0, greatest(3.2e0, 7.8e0 - log2(greatest(greatest(a, 0.05e0), greatest(o, 0.05e0)*0.75e0) + 0.15e0))), 6) AS zoom,
  round(greatest(a*111e0, o*111e0*greatest(cos(radians(la)), 0.2e0))/70, 6) AS grid_resolution_km FROM v"""
    out["event_summary"] = f"""
WITH {ORDERS} SELECT dom AS tectonic_domain, count(*)::BIGINT AS event_count, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day, max(mag) AS maximum_magnitude,
  round(median(mag), 6) AS median_magnitude, median(depth) AS median_depth_km, count(*) FILTER (source = 'IPMA')::BIGINT AS from_ipma FROM cat GROUP BY 1"""
    norm = "trim(regexp_replace(lower(strip_accents(nfc_normalize(t))), '\\s+', ' ', 'g'))"
    subject = " OR ".join(f"contains(n, '{s}')" for s in ("projeto", "project", "observatorio", "plataforma", "aplicacao"))
    phrases = " OR ".join(
        f"contains(n, '{s}')" for s in (
            "quem criou", "quem desenvolveu", "quem fez", "qual e o autor", "qual a autoria", "quem e o criador",
            "criado por quem", "desenvolvido por quem", "e do ipma", "projeto do ipma", "equipa do ipma",
            "relacao com o ipma", "qual e a relacao", "ligacao ao ipma",
            "afiliado ao ipma", "who created", "who developed", "created by", "is this an ipma project",
            "affiliated with ipma"))
    out["text_normalisation"] = f"""
SELECT doc_id, sha1({norm}) AS normalised_sha1, length({norm})::BIGINT AS normalised_length, left(trim(regexp_replace(trim(t), '\\s+', ' ', 'g')), 500) AS preview
FROM (SELECT doc_id, text AS t FROM documents)"""
    claims = (
        r"\b(?:projeto|produto|plataforma|observatorio|iniciativa|servico)(?:\s+experimental)?\s+(?:do|da|de)\s+(?:o\s+)?ipma\b",
        r"\b(?:criado|desenvolvido|mantido|operado|produzido|financiado)\s+(?:pela|pelo)\s+(?:equipa\s+do\s+)?ipma\b",
        r"\bequipa\s+do\s+ipma\s+(?:criou|desenvolveu|mantem|opera)\b",
    )
    affirmed = " OR ".join(
        f"(regexp_matches(x, '{p}') AND NOT regexp_matches(right(regexp_extract(x, '^(.*?)(?:{p})', 1), 55), 'nao |nunca |not '))"
        for p in claims
    )
    out["attribution_guard"] = f"""
SELECT conv_id, turn, ({subject}) AND ({phrases}) AS identity_question,
  len(list_filter(string_split(regexp_replace(n, '([.!?;]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: {affirmed})) > 0 AS false_attribution,
  sha1(n) AS normalised_sha1 FROM (
SELECT conv_id, turn, {norm} AS n FROM (SELECT conv_id, turn, text || ' ' || CASE (conv_id + turn) % 5
 WHEN 0 THEN 'Este é um projeto experimental do IPMA.' WHEN 1 THEN 'Não é um produto do IPMA.' WHEN 2 THEN 'Quem criou o projeto?'
 WHEN 3 THEN 'Foi criado pela equipa do IPMA.' ELSE 'Os dados são públicos.' END AS t FROM conversations))"""
    parsed = """SELECT event_id::VARCHAR AS source_event_id, 'ISC' AS source, epoch_us(date_trunc('second', ts))::BIGINT AS origin_us, (user_id % 40)/10e0 AS latitude, (user_id % 50)/10e0 AS longitude,
  CASE WHEN event_id % 11 <> 0 THEN (user_id % 60)::DOUBLE END AS depth_km, CASE WHEN event_id % 17 <> 0 THEN floor(value)/100e0 END AS magnitude_value"""
    out["fdsn_text"] = f"""
{parsed}, event_type || CASE WHEN (event_id // 100) % 2 = 0 THEN '' ELSE ', the "place"' END AS location_text, round(0.92e0 - CASE WHEN event_id % 17 = 0 THEN 0.08e0 ELSE 0 END - CASE WHEN event_id % 11 = 0 THEN 0.05e0 ELSE 0 END, 6) AS quality_score,
  'reviewed' AS record_status FROM events"""
    out["ipma_json"] = f"""
{parsed.replace("'ISC'", "'IPMA'")}, CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 1 THEN false WHEN event_id % 4 = 2 THEN true END AS felt,
  CASE WHEN event_id % 17 <> 0 AND event_id % 11 <> 0 THEN 0.92e0 ELSE 0.82e0 END AS quality_score FROM events"""
    out["ahead_geojson"] = """
SELECT event_id::VARCHAR AS source_event_id, 'AHEAD' AS source, (1000 + event_id % 900)::INT AS origin_year, month(ts)::INT AS origin_month, (user_id % 40)/10e0 AS latitude, (user_id % 50)/10e0 AS longitude,
  CASE WHEN event_id % 17 <> 0 THEN floor(value)/100e0 END AS magnitude_value, CASE WHEN event_id % 17 <> 0 THEN 'Mw' END AS magnitude_type,
  greatest((event_id % 5)::DOUBLE, (event_id % 3)::DOUBLE) AS location_uncertainty_km, CASE WHEN event_id % 17 <> 0 THEN 0.72e0 ELSE 0.58e0 END AS quality_score FROM events"""
    out["month_chunks"] = """
WITH RECURSIVE spans AS (
  SELECT o_orderpriority AS dom, o_orderkey % 40 AS part, min(o_orderdate)::TIMESTAMP AS lo, max(o_orderdate)::TIMESTAMP AS hi FROM orders GROUP BY ALL
), chunks AS (
  SELECT dom, part, lo AS a, least(lo + INTERVAL 1 MONTH, hi) AS b, hi FROM spans WHERE lo < hi
  UNION ALL SELECT dom, part, b, least(b + INTERVAL 1 MONTH, hi), hi FROM chunks WHERE b < hi)
SELECT dom AS tectonic_domain, part::BIGINT AS part, a::DATE::VARCHAR AS chunk_start, b::DATE::VARCHAR AS chunk_end FROM chunks"""
    out["incremental_fingerprints"] = out["fingerprints"]
    out["snapshot_pushdown"] = f"""
WITH {ORDERS} SELECT id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%d') AS day, lat AS latitude, lon AS longitude, mag AS magnitude_value, source
FROM cat WHERE ts >= '2006-01-01' AND ts < '2009-07-01' AND lat BETWEEN 36.5e0 AND 39.25e0 AND lon >= -11 AND mag >= 2"""
    asked_held = """
asked AS (SELECT DISTINCT o_custkey AS feed, o_orderdate::DATE AS s, o_orderdate::DATE + (20 + o_orderkey % 90)::INT AS e FROM orders),
held AS (SELECT DISTINCT o_custkey AS feed, unnest(generate_series(l_shipdate::DATE, l_shipdate::DATE + l_quantity::INT - 1, INTERVAL 1 DAY))::DATE AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
    out["range_gaps"] = f"""
WITH {asked_held},
days AS (SELECT DISTINCT feed, unnest(generate_series(s, e - 1, INTERVAL 1 DAY))::DATE AS d FROM asked),
missing AS (SELECT feed, d, d - row_number() OVER (PARTITION BY feed ORDER BY d)::INT AS island FROM days ANTI JOIN held USING (feed, d))
SELECT feed, strftime(min(d), '%Y-%m-%d') AS gap_start, strftime(max(d) + 1, '%Y-%m-%d') AS gap_end FROM missing GROUP BY feed, island"""
    out["range_manifest"] = f"""
WITH {asked_held}
SELECT feed, strftime(s, '%Y-%m-%d') AS start_day, strftime(e, '%Y-%m-%d') AS end_day,
  CASE WHEN n = e - s THEN 'complete' WHEN n > 0 THEN 'partial' ELSE 'failed' END AS status, n::BIGINT AS held_days
FROM (SELECT a.feed, s, e, count(d) AS n FROM asked a LEFT JOIN held h ON h.feed = a.feed AND d >= s AND d < e GROUP BY a.feed, s, e)"""
    out["historical_csv"] = """
SELECT event_id::VARCHAR AS source_event_id, strftime(ts, '%Y-%m-%d') AS day, 36 + (user_id % 40)/10e0 AS latitude, -12 + (user_id % 50)/10e0 AS longitude,
  CASE WHEN event_id % 11 <> 0 THEN (user_id % 60)::DOUBLE END AS depth_km, CASE WHEN event_id % 17 <> 0 THEN floor(value)/100e0 END AS magnitude_value,
  event_type || ', ' || user_id % 7 AS location_text, 'IPMA_HISTORICAL' AS source, 'historical' AS record_status, 0.72e0 AS quality_score FROM events WHERE event_id % 19 <> 0"""
    out["combined_chunks"] = f"""
WITH {EVENTS} SELECT id::VARCHAR AS event_id, CASE WHEN id % 3 = 0 THEN 'chunk-1' ELSE 'chunk-2' END AS source_file, mag + CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS magnitude_value FROM cat"""
    out["silver_metadata"] = f"""
WITH {ORDERS} SELECT source, count(*) AS said, count(*) AS found, (SELECT count(*) FROM cat) AS row_count, {len(EVENT_FIELDS)}::INT AS columns FROM cat GROUP BY source"""
    out["report_counts"] = f"""
WITH {ORDERS}, kept AS (SELECT * FROM cat WHERE pref)
SELECT 'sources' AS part, source AS name, count(*) AS events FROM kept GROUP BY source
UNION ALL SELECT 'domains', dom, count(*) FROM kept GROUP BY dom
UNION ALL SELECT 'overview', strftime(min(ts), '%Y-%m-%d') || '/' || strftime(max(ts), '%Y-%m-%d'), count(*) FROM kept"""

    def percent(p: str) -> str:
        return f"coalesce(printf('%.1f%%', ({p})*100), 'n/d')"

    out["replay_texts"] = f"""
SELECT o_orderdate::TIMESTAMP AS cutoff, 3e0 + o_orderkey % 4/2e0 AS threshold_magnitude, (o_custkey % 90)::INT AS horizon_days,
  strftime(o_orderdate, '%Y-%m-%d') || ' + ' || o_custkey % 90 || ' dias, M≥' || printf('%.1f', 3e0 + o_orderkey % 4/2e0) || ': famílias '
  || {percent("CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 101/100e0 END")} || ', frequência histórica ' || {percent("o_orderkey % 101/100e0")}
  || ', Poisson ' || {percent("o_orderkey % 51/50e0")} || ' (época ' || CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE 'n/d' END || ', '
  || CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 500 ELSE 0 END || ' eventos em ' || printf('%.1f', (o_orderkey % 9000)/365.25e0) || ' anos). Observado: '
  || CASE WHEN o_orderkey % 2 = 0 THEN 'sim' ELSE 'não' END || '.' AS summary FROM orders"""
    out["cluster_pyramid"] = f"""
WITH {ORDERS},
fine AS (SELECT *, least(greatest(floor((lon + 180e0)/360e0*4096), 0), 4095)::BIGINT AS x, least(greatest(floor((lat + 90e0)/180e0*4096), 0), 4095)::BIGINT AS y FROM cat),
each AS (SELECT *, unnest(generate_series(0, 12)) AS level FROM fine),
made AS (
  SELECT level, x >> (12 - level)::BIGINT AS cx, y >> (12 - level)::BIGINT AS cy, count(*) AS events, sum(lat) AS alat, sum(lon) AS alon, max(mag) AS m,
    arg_min(id::VARCHAR, (-mag, id::VARCHAR)) AS strongest,
    CASE WHEN level < 12 THEN count(DISTINCT (x >> greatest(11 - level, 0)::BIGINT, y >> greatest(11 - level, 0)::BIGINT)) END AS children,
    greatest(xor(min(x), max(x)), xor(min(y), max(y))) AS apart
  FROM each GROUP BY level, cx, cy)
SELECT level::INT AS level, events::BIGINT AS events, round(alat, 4) AS latitude_sum, round(alon, 4) AS longitude_sum, m AS maximum_magnitude, strongest AS strongest_event,
  children::INT AS children, CASE WHEN apart > 0 THEN (12 - floor(log2(apart)))::INT END AS expand_level, round(least(34e0, greatest(8e0, sqrt(events)*2.8e0 + 7)), 6) AS marker_size FROM made"""
    years = EPOCH.format(y="year(ts - to_years((5 * (id % 40))::INT))")
    out["sql_functions"] = out["scalar_physics"].replace(" AS window_days FROM cat", f" AS window_days, {years} AS epoch FROM cat")
    out["sql_windows"] = f"""
WITH o AS (SELECT o_orderpriority AS region, o_orderdate::DATE AS d, (o_orderstatus = 'F')::INT AS f FROM orders),
w AS (SELECT region, i, lo + (i*7)::INT AS a, lo + (i*7 + 89)::INT AS b
  FROM (SELECT region, lo, unnest(generate_series(0, (hi - lo - 89) // 7)) AS i FROM (SELECT region, min(d) AS lo, max(d) AS hi FROM o GROUP BY region) WHERE hi - lo >= 89)),
c AS (SELECT w.region, i, a, b, count(*) AS n, avg(f) AS p FROM w JOIN o ON o.region = w.region AND d BETWEEN a AND b GROUP BY ALL),
l AS (SELECT *, {wilson("p", "n")[0]} AS lo, {wilson("p", "n")[1]} AS hi FROM c)
SELECT region, i::INT AS window_index, strftime(a, '%Y-%m-%d') AS window_start, strftime(b, '%Y-%m-%d') AS window_end, n::BIGINT AS orders, round(lo, 6) AS lower, round(hi, 6) AS upper,
  CASE WHEN n < 5 THEN 'watch' WHEN lo >= 0.8e0 THEN 'high' WHEN hi < 0.8e0 THEN 'normal' ELSE 'watch' END AS level FROM l"""
    out["versioned_catalogue"] = f"""
WITH {ORDERS},
states AS (
  SELECT 1 AS version, source, mag FROM cat
  UNION ALL SELECT v, source, CASE WHEN source = 'ISC' THEN mag + 1 ELSE mag END FROM cat, (VALUES (2), (4)) AS n(v) WHERE source <> 'ISC' OR mag < 20
  UNION ALL SELECT 3, source, mag FROM cat WHERE source <> 'ISC')
SELECT version, source, count(*) AS events, round(sum(mag), 4) AS magnitude_sum FROM states GROUP BY version, source"""
    out["stream_revisions"] = """
SELECT o_orderkey AS event_id, strftime(o_orderdate + CASE WHEN o_orderkey % 14 = 0 THEN INTERVAL 400 DAY ELSE INTERVAL 0 DAY END, '%Y-%m-%d') AS day,
  floor(o_totalprice/10000)/10e0 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS magnitude_value, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS revision
FROM orders WHERE o_orderkey % 21 <> 0"""
    rings = [("x", "y", "r"), ("x", "y", "r / 2"), ("x + r * 2", "y", "r / 4")]
    turns = []
    for cx, cy, size in rings:
        corners = [(f"({cx}) + {size}", cy), (cx, f"{cy} + {size}"), (f"({cx}) - {size}", cy), (cx, f"{cy} - {size}")]
        turns += [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]
    sides = " UNION ALL ".join(
        f"SELECT k, name, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM shape" for x1, y1, x2, y2 in turns
    )
    out["polygon_layer"] = f"""
WITH {ORDERS},
shape AS (SELECT c_custkey AS k, c_name AS name, -12 + (c_custkey * 104729 % 50000)/10000e0 AS x, 36 + (c_custkey * 7919 % 40000)/10000e0 AS y,
  0.03e0 + (c_custkey % 7)/50e0 + c_custkey/1e7 AS r FROM customer),
sides AS ({sides}),
points AS (SELECT DISTINCT lat, lon FROM cat),
tested AS (
  SELECT lat, lon, k, name,
    bool_or((lon - x1)*(y2 - y1) - (lat - y1)*(x2 - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2))
      OR count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1)*(lat - y1)/(y2 - y1) + x1) % 2 = 1 AS hit,
    min(sqrt(pow(lon - (least(1e0, greatest(0e0, ((lon - x1)*(x2 - x1) + (lat - y1)*(y2 - y1))/((x2 - x1)*(x2 - x1) + (y2 - y1)*(y2 - y1))))*(x2 - x1) + x1), 2)
      + pow(lat - (least(1e0, greatest(0e0, ((lon - x1)*(x2 - x1) + (lat - y1)*(y2 - y1))/((x2 - x1)*(x2 - x1) + (y2 - y1)*(y2 - y1))))*(y2 - y1) + y1), 2))) AS d
  FROM points, sides GROUP BY lat, lon, k, name
),
best AS (
  SELECT lat, lon, count(*) FILTER (WHERE hit) AS hits, arg_min(name, r) FILTER (WHERE hit) AS inner_name, min(d) AS d, arg_min(name, d) AS near_name
  FROM tested JOIN shape USING (k, name) GROUP BY lat, lon
)
SELECT id::VARCHAR AS event_id, CASE WHEN hits > 0 THEN inner_name WHEN d <= 0.25 THEN near_name ELSE '{OUTSIDE_REGION}' END AS tectonic_domain,
  CASE WHEN hits = 1 THEN 0.9e0 WHEN hits > 1 THEN 0.85e0 WHEN d <= 0.25 THEN 0.45e0 ELSE 0.2e0 END AS domain_confidence
FROM cat JOIN best USING (lat, lon)"""
    return out
