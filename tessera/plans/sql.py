"""SQL for the registered queries, and the literal rows that some of them take."""

from __future__ import annotations

from tessera.schema import BLOCK, DIMS, FRAUD_FROM, MCC_RISK, NEIGHBOURS, OTHER_RISK

CLUSTERS, PROBES = 32, 4

GOOD = '"transaction":{"amount":1.5,"installments":2,"requested_at":"2024-01-01T00:00:00Z"},"customer":{"avg_amount":2.0,"tx_count_24h":1,"known_merchants":["M-1"]},"merchant":{"id":"M-1","mcc":"5411","avg_amount":3.0},"terminal":{"is_online":true,"card_present":false,"km_from_home":4.5}'
_WITHOUT_MERCHANT = GOOD.replace('"merchant":{"id":"M-1","mcc":"5411","avg_amount":3.0},', "")
#: (id, body); the second list has the status of each.
MALFORMED = [
    (1, "{" + GOOD + "}"),
    (2, "{" + GOOD + ',"last_transaction":null}'),
    (3, "{" + GOOD + ',"other":[1,{"x":2}]}'),
    (4, "{" + _WITHOUT_MERCHANT + "}"),
    (5, "{" + GOOD.replace('"amount":1.5', '"amount":"1"') + "}"),
    (6, "{" + GOOD.replace('"installments":2', '"installments":2.0') + "}"),
    (7, "{bad"),
    (8, "{" + GOOD.replace("2024-01-01T", "2024-13-01T") + "}"),
    (9, "{" + GOOD + ',"last_transaction":{"timestamp":"2024-01-01T00:00","km_from_current":1.0}}'),
    (10, "{" + GOOD + ',"last_transaction":{"timestamp":"2024-01","km_from_current":1.0}}'),
    (11, "{" + GOOD + ',"last_transaction":{"timestamp":"2024-01-01T00:00"}}'),
    (12, ""),
    (13, "{" + GOOD + "} x"),
    (14, "{" + GOOD + "}{}"),
    (15, " {" + GOOD + "}\n\t"),
    (16, "{" + GOOD.replace('"amount":1.5', '"amount":1.5,"amount":1.5') + "}"),
    (17, "{" + GOOD + ',"terminal":{"is_online":true,"card_present":false,"km_from_home":4.5}}'),
    (18, "{" + GOOD + ',"other":1,"other":"} ]"}'),
    (19, "{" + GOOD + ',"last_transaction":null,"last_transaction":null}'),
]
STATUSES = [200, 200, 200, 400, 400, 400, 400, 400, 200, 400, 400, 400, 400, 400, 200, 400, 400, 200, 400]
STAMPS = [
    ("leap", "2024-02-31T10:00:00Z"),
    ("marks", "2024/01/01x00:00"),
    ("short", "2024-01-01T00:0"),
    ("letter", "20a4-01-01T00:00"),
    ("month", "2024-13-01T00:00"),
    ("hour", "2024-01-01T24:00"),
    ("minute", "2024-01-01T23:60"),
    ("zero", "2024-00-01T00:00"),
    ("day", "2024-01-32T00:00"),
    ("sunday", "2024-01-07T00:00"),
    ("old", "1999-12-31T23:59:59+02:00"),
]
INTERVALS = [
    ("month end", "2024-01-31T12:00", "2024-02-01T12:00"),
    ("february", "2023-02-28T12:00", "2023-03-01T12:00"),
    ("year end", "2023-12-31T12:00", "2024-01-01T12:00"),
    ("almost", "2024-01-30T12:00", "2024-02-01T11:59"),
    ("back", "2024-02-01T00:00", "2024-01-01T00:00"),
]
MCCS = [("plain", "5411"), ("plus", "+5411"), ("spaces", " 5411 "), ("letters", "abc"), ("none", ""), ("minus", "-5411"), ("long", "99999999999999999999"), ("over", "4294967296"), ("under", "4294967295")]
WRAPS = [-1, 0, 255, 256, 300, -256, 2147483647, -2147483648]
RAW_REQUESTS = [
    (1, "GET /ready HTTP/1.1\r\n\r\n"),
    (2, "POST /fraud-score HTTP/1.1\r\nContent-Length: 5\r\n\r\nhello"),
    (3, "POST /fraud-score HTTP/1.1\r\ncontent-length:   3\r\nConnection: close\r\n\r\nhello"),
    (4, "PUT /fraud-score?x=1 HTTP/1.1\r\nconnection: Close\r\n\r\n"),
    (5, "GET /other HTTP/1.1\r\nConnection: keep-alive\r\n\r\n"),
    (6, "POST /fraud-score HTTP/1.1\r\nContent-Length: 9\r\n\r\nhello"),
    (7, "GET /ready HTTP/1.1\r\n"),
    (8, "POST /fraud-score HTTP/1.1\r\nContent-Length: 10\r\n\r\n{\"a\":\"é\"}GET /ready HTTP/1.1\r\n\r\nGET /x"),
    (9, "GET /ready HTTP/1.1\r\nConnection: close\r\n\r\nGET /ready HTTP/1.1\r\n\r\n"),
    (10, "POST /a HTTP/1.1\r\nContent-Length: 8\r\n\r\n\r\n\r\nabcdGET /b HTTP/1.1\r\n\r\n"),
]


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def r4(x: str) -> str:
    return f"CAST(round(CAST(({x}) * 10000::FLOAT AS FLOAT)) * 0.0001::FLOAT AS FLOAT)"


def c01(x: str) -> str:
    return r4(f"greatest(least({x}, 1::FLOAT), 0::FLOAT)")


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS FLOAT) / CAST({b} AS FLOAT))"


def mins(ts: str) -> str:
    return f"(year({ts}) * 525600 + month({ts}) * 43200 + day({ts}) * 1440 + hour({ts}) * 60 + minute({ts}))"


def average(over: str) -> str:
    return f"CAST(CAST(sum(cents) OVER (PARTITION BY {over}) AS DOUBLE) / CAST(count(*) OVER (PARTITION BY {over}) AS DOUBLE) / 100 * 40 AS FLOAT)"


_CODES = [*map(str, MCC_RISK), "0000", "abc"]
_RISK = "CASE mcc " + " ".join(f"WHEN {k} THEN {r}" for k, r in MCC_RISK.items()) + f" ELSE {OTHER_RISK} END"
TX = f"""
base AS (
    SELECT event_id, user_id, ts, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events
), tx AS (
    SELECT event_id, ts, k, CAST(CAST(cents AS DOUBLE) / 100 * 40 AS FLOAT) AS amount, CAST(event_id % 14 AS INTEGER) AS installments,
        CASE WHEN user_id % 10 = 0 THEN 0::FLOAT ELSE {average("user_id")} END AS customer_avg_amount, {average("k")} AS merchant_avg_amount,
        3 * (count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - 1) AS tx_count_24h,
        row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) = 1 AS is_unknown_merchant,
        ([{", ".join(map(text, _CODES))}])[k % 12 + 1] AS mcc_text, event_type IN ('view', 'click') AS is_online, event_type = 'purchase' AS card_present,
        CAST(event_id * 7919 % 1500 AS FLOAT) AS km_from_home, CAST(event_id * 104729 % 1500 AS FLOAT) AS km_raw,
        lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS fraud
    FROM base
), pay AS (
    SELECT event_id, fraud, amount, customer_avg_amount, merchant_avg_amount, km_from_home, CASE WHEN last_ts IS NULL THEN 0::FLOAT ELSE km_raw END AS km_from_current,
        CAST(tx_count_24h AS BIGINT) AS tx_count_24h, CAST(coalesce(TRY_CAST(mcc_text AS BIGINT), 0) AS BIGINT) AS mcc,
        CAST(CASE WHEN last_ts IS NULL THEN 0 ELSE greatest({mins("ts")} - {mins("last_ts")}, 0) END AS BIGINT) AS minutes_since_last,
        installments, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) AS INTEGER) AS day_of_week, is_online, card_present, is_unknown_merchant, last_ts IS NOT NULL AS has_last_tx
    FROM tx
)"""
_F = [
    c01(div("amount", "10000")), c01(div("installments", "12")),
    c01(f"CASE WHEN customer_avg_amount > 0 THEN {div(div('amount', 'customer_avg_amount'), '10')} ELSE 1::FLOAT END"),
    r4(div("hour", "23")), r4(div("day_of_week", "6")),
    f"CASE WHEN has_last_tx THEN {c01(div('minutes_since_last', '1440'))} ELSE -1::FLOAT END", f"CASE WHEN has_last_tx THEN {c01(div('km_from_current', '1000'))} ELSE -1::FLOAT END",
    c01(div("km_from_home", "1000")), c01(div("tx_count_24h", "20")), "CAST(is_online AS FLOAT)", "CAST(card_present AS FLOAT)", "CAST(is_unknown_merchant AS FLOAT)", f"CAST({_RISK} AS FLOAT)", c01(div("merchant_avg_amount", "10000")),
]
FEAT = TX + ", feat AS (SELECT event_id, fraud, " + ", ".join(f"CAST({x} AS FLOAT) AS f{i}" for i, x in enumerate(_F)) + " FROM pay)"
_Q = [f"CAST(round(CAST(f{i} * 10000::FLOAT AS FLOAT)) AS INTEGER)" for i in range(DIMS)]
EVENTS = "WITH " + FEAT + f", v AS (SELECT event_id AS vec_id, fraud AS label, [{', '.join(_Q)}] AS q FROM feat)"
EMBEDDED = "WITH v AS (SELECT vec_id, CAST(label AS INTEGER) AS label, list_transform(embedding, lambda x: CAST(round(CAST(x * 10000::FLOAT AS FLOAT)) AS INTEGER)) AS q FROM embeddings)"


def l2(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (CAST(z[1] AS BIGINT) - z[2]) * (CAST(z[1] AS BIGINT) - z[2]))) AS BIGINT)"


ASKED = ", asked AS (SELECT vec_id AS qid, q AS x FROM v WHERE vec_id % 50 = 0)"
EVERY = ", asked AS (SELECT vec_id AS qid, q AS x FROM v)"
SEEDS = f"""
, numbered AS (SELECT q, vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS rn, greatest(count(*) OVER () // {CLUSTERS}, 1) AS step FROM v)
, seeds AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster_id, q AS c FROM numbered WHERE rn % step = 0 AND rn < step * {CLUSTERS})"""


def assigned(name: str, centroids: str) -> str:
    return f", {name} AS (SELECT vec_id, label, q, arg_min(cluster_id, (d, cluster_id)) AS cluster_id FROM (SELECT vec_id, label, q, cluster_id, {l2('q', 'c')} AS d FROM v, {centroids}) GROUP BY vec_id, label, q)"


PASS = SEEDS + assigned("first", "seeds") + f"""
, sums AS (SELECT cluster_id, i, CAST(round(CAST(sum(q[i]) AS DOUBLE) / count(*)) AS INTEGER) AS m FROM first, (SELECT unnest(range(1, len((SELECT any_value(q) FROM v)) + 1)) AS i) GROUP BY cluster_id, i)
, means AS (SELECT cluster_id, list(m ORDER BY i) AS c FROM sums GROUP BY cluster_id)
, centroids AS (SELECT s.cluster_id, coalesce(m.c, s.c) AS c FROM seeds s LEFT JOIN means m USING (cluster_id))""" + assigned("lists", "centroids")
OFFSETS = f"""
, sizes AS (SELECT c.cluster_id, CAST(count(l.vec_id) AS BIGINT) AS size FROM centroids c LEFT JOIN lists l USING (cluster_id) GROUP BY c.cluster_id)
, padded AS (SELECT cluster_id, size, CAST(ceil(size / {BLOCK}.0) * {BLOCK} AS BIGINT) AS padded FROM sizes)
, offsets AS (SELECT cluster_id, size, padded, CAST(coalesce(sum(padded) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM padded)"""


def nearest(pairs: str, k: int = NEIGHBOURS) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM ({pairs})) WHERE rank <= {k})"


def scored(asked: str, near: str) -> str:
    return f"SELECT qid, fraud_count, fraud_count / 5.0::DOUBLE AS fraud_score, fraud_count < {FRAUD_FROM} AS approved FROM (SELECT a.qid, CAST(coalesce(sum(n.label), 0) AS BIGINT) AS fraud_count FROM {asked} a LEFT JOIN {near} n USING (qid) GROUP BY a.qid)"


def _all(where: str) -> str:
    return f"SELECT qid, vec_id, label, {l2('x', 'q')} AS distance FROM asked, v WHERE {where}"


def _probed(asked: str, n: int) -> str:
    return f"(SELECT qid, x, cluster_id FROM (SELECT qid, x, cluster_id, row_number() OVER (PARTITION BY qid ORDER BY {l2('x', 'c')}, cluster_id) AS r FROM {asked}, centroids) WHERE r <= {n})"


def _ivf(asked: str, n: int) -> str:
    return f"SELECT qid, vec_id, label, {l2('x', 'q')} AS distance FROM {_probed(asked, n)} JOIN lists USING (cluster_id)"


def stamp_parts(rows: str) -> str:
    """id, text of rows to the parts of a stamp, by text alone."""
    n = {c: f"TRY_CAST(substr(text, {s}, {k}) AS INTEGER)" for c, s, k in (("year", 1, 4), ("month", 6, 2), ("day", 9, 2), ("hour", 12, 2), ("minute", 15, 2))}
    ok = f"regexp_matches(text, '(?s)^[0-9]{{4}}.[0-9]{{2}}.[0-9]{{2}}.[0-9]{{2}}.[0-9]{{2}}') AND {n['month']} BETWEEN 1 AND 12 AND {n['day']} BETWEEN 1 AND 31 AND {n['hour']} <= 23 AND {n['minute']} <= 59"
    parts = ", ".join(f"CASE WHEN {ok} THEN {v} END AS {c}" for c, v in n.items())
    y = "(year - CASE WHEN month < 3 THEN 1 ELSE 0 END)"
    return f"SELECT id, {', '.join(f'coalesce({c}, -1) AS {c}' for c in n)}, coalesce(CAST(({y} + {y} // 4 - {y} // 100 + {y} // 400 + ([0, 3, 2, 5, 0, 3, 5, 1, 4, 6, 2, 4])[month] + day) % 7 AS INTEGER), -1) AS weekday FROM (SELECT id, {parts} FROM {rows})"


def _accuracy() -> str:
    sample = "SELECT vec_id AS qid, q AS x FROM (SELECT vec_id, q, row_number() OVER (ORDER BY vec_id) - 1 AS rn, greatest(count(*) OVER () // 200, 1) AS step FROM v) WHERE rn % step = 0 AND rn < step * 200"
    a, e = scored("asked", nearest(_ivf("asked", PROBES))), scored("asked", nearest(_all("true")))
    return f"""{EVENTS} , asked AS ({sample}) {PASS}, a AS ({a}), e AS ({e}), b AS (SELECT a.fraud_count AS a, e.fraud_count AS e FROM a JOIN e USING (qid))
        SELECT count(*) AS queries, count(*) FILTER (a <> e) AS mismatch, count(*) FILTER (a <> e AND a >= {FRAUD_FROM} AND e < {FRAUD_FROM}) AS fp,
            count(*) FILTER (a <> e AND NOT (a >= {FRAUD_FROM} AND e < {FRAUD_FROM})) AS other, count(*) FILTER (a < {FRAUD_FROM} AND e >= {FRAUD_FROM}) AS fn,
            100.0::DOUBLE * count(*) FILTER (a <> e) / count(*) AS mismatch_pct FROM b"""


def _responses() -> str:
    crlf = "chr(13) || chr(10)"
    body = "'{\"approved\":' || CASE WHEN fraud_count < 3 THEN 'true' ELSE 'false' END || ',\"fraud_score\":' || CAST(CAST(fraud_count / 5.0 AS DECIMAL(2, 1)) AS VARCHAR) || '}'"
    close = f"CASE WHEN qid % 100 = 0 THEN 'Connection: close' || {crlf} ELSE '' END"
    return f"SELECT qid AS event_id, 200 AS status, 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: application/json' || {crlf} || 'Content-Length: ' || length({body}) || {crlf} || {close} || {crlf} || {body} AS response FROM ({FLAGSHIP_BODY})"


FLAGSHIP_BODY = scored("asked", nearest(_all("qid <> vec_id")))
FLAGSHIP = f"{EVENTS} {ASKED} {FLAGSHIP_BODY}"
_DIMS = "(SELECT unnest(range(1, 65)) AS i)"
_STATS = f"""SELECT CAST(sum(size) AS BIGINT) AS n, count(*) AS k, 64 AS d, CAST(sum(padded) AS BIGINT) AS padded_n, 4 * 64 * count(*) AS centroid_bytes, 4 * (count(*) + 1) AS offset_bytes, CAST(sum(padded) AS BIGINT) AS label_bytes,
    CAST(sum(padded) * 128 AS BIGINT) AS block_bytes, CAST(16 + 4 * 64 * count(*) + 4 * (count(*) + 1) + sum(padded) * 129 AS BIGINT) AS total_bytes, avg(size) AS avg_size, max(size) AS max_size, min(size) AS min_size, count(*) FILTER (size > 0) AS non_empty FROM offsets"""
_WEIGHED = "SELECT event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY event_id) AS c, sum(CAST(round(value * 100) AS BIGINT)) OVER () AS t FROM events"

ORACLE_SQL: dict[str, str] = {
    "json_parse_payload": f"WITH {TX} SELECT event_id, 200 AS status, * EXCLUDE (event_id, fraud) FROM pay",
    "json_reject_malformed": f"SELECT * FROM (VALUES {values([(i, s) for (i, _), s in zip(MALFORMED, STATUSES, strict=True)])}) AS t(id, status)",
    "iso_parse": stamp_parts(f"(SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text FROM events UNION ALL SELECT * FROM (VALUES {values(STAMPS)}) AS t(id, text))"),
    "minutes_between": f"WITH {TX} SELECT CAST(event_id AS VARCHAR) AS id, CAST(greatest({mins('ts')} - {mins('last_ts')}, 0) AS BIGINT) AS minutes FROM tx WHERE last_ts IS NOT NULL UNION ALL SELECT * FROM (VALUES ('month end', 0), ('february', 4320), ('year end', 7200), ('almost', 1439), ('back', 0)) AS t(id, minutes)",
    "day_of_week": "SELECT event_id, CAST(dayofweek(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour FROM events",
    "mcc_risk": f"WITH {TX} SELECT id, mcc, CAST({_RISK} AS FLOAT) AS risk FROM (SELECT CAST(event_id AS VARCHAR) AS id, mcc FROM pay UNION ALL SELECT * FROM (VALUES ('plain', 5411::BIGINT), ('plus', 5411), ('spaces', 0), ('letters', 0), ('none', 0), ('minus', 0), ('long', 0), ('over', 0), ('under', 4294967295)) AS t(id, mcc))",
    "wrapping_casts": f"SELECT x, ((x::BIGINT % 256) + 256) % 256 AS as_u8, ((x::BIGINT % 4294967296) + 4294967296) % 4294967296 AS as_u32 FROM (VALUES {values([(x,) for x in WRAPS])}) AS t(x)",
    "feature_vector": f"WITH {FEAT} SELECT * EXCLUDE (fraud) FROM feat",
    "quantize": f"WITH {FEAT} SELECT event_id, {', '.join(f'{x} AS q{i}' for i, x in enumerate(_Q))} FROM feat",
    "quantize_embeddings": f"{EMBEDDED} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, q[i] AS q FROM v, {_DIMS}",
    "label_indicator": f"WITH {TX} SELECT event_id, fraud FROM tx",
    "l2_pairs": f"{EMBEDDED} {ASKED} SELECT qid, vec_id, {l2('x', 'q')} AS distance FROM asked, v",
    "float_distances": "SELECT a.vec_id, list_reduce(list_concat([0::FLOAT], list_transform(range(1, len(a.embedding) + 1), lambda i: CAST((a.embedding[i]::FLOAT - b.embedding[i]::FLOAT) * (a.embedding[i]::FLOAT - b.embedding[i]::FLOAT) AS FLOAT))), lambda s, v: CAST(s + v AS FLOAT)) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1",
    "unscaled_distances": f"{EMBEDDED} {ASKED} SELECT qid, vec_id, CAST(CAST(CAST({l2('x', 'q')} AS FLOAT) * 0.0001::FLOAT AS FLOAT) * 0.0001::FLOAT AS FLOAT) AS distance FROM asked, v",
    "centroid_probe_topn": f"{EMBEDDED} {ASKED} {SEEDS} SELECT qid, cluster_id, distance, CAST(r AS INTEGER) AS probe_rank FROM (SELECT qid, cluster_id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, cluster_id) AS r FROM (SELECT qid, cluster_id, {l2('x', 'c')} AS distance FROM asked, seeds)) WHERE r <= 10",
    "exact_knn5_score": FLAGSHIP,
    "exact_knn5_embeddings": f"{EMBEDDED} {ASKED} SELECT qid, vec_id, distance, label, CAST(rank AS INTEGER) AS rank FROM {nearest(_all('true'))}",
    "ivf_knn5_score": f"{EVENTS} {ASKED} {PASS} {scored('asked', nearest(_ivf('asked', PROBES)))}",
    "kmeans_assign": f"{EMBEDDED} {SEEDS} {assigned('first', 'seeds')} SELECT vec_id, cluster_id FROM first",
    "kmeans_update": f"{EMBEDDED} {PASS} SELECT cluster_id, CAST(i - 1 AS INTEGER) AS dim, c[i] AS q FROM centroids, {_DIMS}",
    "kmeans_changed": f"{EMBEDDED} {PASS} SELECT count(*) AS total, count(*) FILTER (f.cluster_id <> l.cluster_id) AS changed FROM first f JOIN lists l USING (vec_id)",
    "systematic_sample": "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn, greatest(count(*) OVER () // 200, 1) AS step FROM events) WHERE rn % step = 0 AND rn < step * 200",
    "weighted_pick": f"SELECT f AS fraction, min(event_id) AS event_id, CAST(min(c) AS BIGINT) AS cumulative FROM ({_WEIGHED}), (VALUES (0.125::DOUBLE), (0.5), (0.875)) AS g(f) WHERE c >= t * f GROUP BY f",
    "posting_offsets": f"{EMBEDDED} {PASS} {OFFSETS} SELECT * FROM offsets",
    "index_stats": f"{EMBEDDED} {PASS} {OFFSETS} {_STATS}",
    "phantom_padding": "SELECT * FROM (VALUES ('on', 7::BIGINT, 0::BIGINT, true), ('off', 7, 1, true)) AS t(padding, qid, fraud_count, approved)",
    "ann_accuracy": _accuracy(),
    "index_parquet_roundtrip": f"{EMBEDDED} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, q[i] AS q FROM v, {_DIMS}",
    "index_binary_roundtrip": f"{EVENTS} {PASS} SELECT cluster_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS frauds, CAST(sum(q[1]) AS BIGINT) AS sum_q0, CAST(sum(q[14]) AS BIGINT) AS sum_q13 FROM lists GROUP BY cluster_id",
    "references_json": f"{EVENTS} SELECT label, count(*) AS n, {', '.join(f'CAST(sum(q[{i + 1}]) AS BIGINT) AS sum_q{i}' for i in range(DIMS))} FROM v GROUP BY label",
    "http_routes": "SELECT * FROM (VALUES (1, 0, '/ready', 0, false, true, 0, 200, 200), (2, 0, '/fraud-score', 5, false, true, 5, 400, 503), (3, 0, '/fraud-score', 3, true, true, 3, 400, 503), (4, 0, '/fraud-score?x=1', 0, true, true, 0, 404, 503), (5, 0, '/other', 0, false, true, 0, 404, 503), (6, 0, '/fraud-score', 9, false, false, 5, 400, 503), (7, 0, '/ready', 0, false, false, 0, 200, 200), (8, 0, '/fraud-score', 10, false, true, 9, 400, 503), (8, 1, '/ready', 0, false, true, 0, 200, 200), (8, 2, '/x', 0, false, false, 0, 404, 503), (9, 0, '/ready', 0, true, true, 0, 200, 200), (10, 0, '/a', 8, false, true, 8, 404, 503), (10, 1, '/b', 0, false, true, 0, 404, 503)) AS t(id, place, path, content_length, close, complete, body_chars, status, status_unready)",
    "http_scores": f"{EVENTS} {ASKED} {_responses()}",
    "stream_score": f"{EVENTS} {EVERY} {FLAGSHIP_BODY}",
}
