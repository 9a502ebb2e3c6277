"""Queries of the conversation and command operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import hmac_sha256
from ..streaming import chat, commands, signed
from .catalog import query, read

# What users of the queries write: by event number.
_TEXTS = ["terminé", "1", "2", "terminé", "1", "PAT-7", "3", "1", "12 ans", "1", "5", "tout", "retour", "Groupe sanguin", "4", "3/4/2024", "1.", "?", "31/2/2024"]
_RARE = ["annuler", "/aide", "CIN : AB123456", "/x", "Téléphone", "-", "stop", "/status"]


def messages(spark, sf_dir: str):
    """Events as messages: views are photos, the others answers; 20 seconds count as one."""
    n = F.col("event_id")
    pick = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    numbers = F.filter(F.sequence(F.lit(1), F.lit(3)), lambda f: f <= n % 4)
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("user"), n.alias("message_id"), F.timestamp_micros(F.expr("unix_micros(cast(cast(ts as string) || 'Z' as timestamp)) div 20")).alias("at"),
        F.when(F.col("event_type") == "view", "image").otherwise("text").alias("kind"), F.when(n % 41 < 8, pick(_RARE, n % 41)).otherwise(pick(_TEXTS, n % 19)).alias("text"), (n % 7 == 0).alias("error"),
        F.transform(numbers, lambda f: pick(["integer", "date", "text"], (n + f) % 3)).alias("kinds"), F.filter(numbers, lambda f: (n + f) % 3 == 0).cast("array<int>").alias("doubtful"),
        F.when(n % 2 == 0, F.concat(F.lit("C-"), (n % 50).cast("string"))).alias("code"), (n % 12).cast("int").alias("n_candidates"),
    )


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_STEPS = f"""
WITH RECURSIVE e AS (
 SELECT user_id AS u, event_id AS n, epoch_us(ts) // 20 AS tm, event_type = 'view' AS image, CASE WHEN event_id % 41 < 8 THEN {_sql_list(_RARE)}[event_id % 41 + 1] ELSE {_sql_list(_TEXTS)}[event_id % 19 + 1] END AS t, range(1, event_id % 4 + 1) AS f FROM events WHERE user_id IS NOT NULL),
m AS (
 SELECT u AS mu, n, tm AS mat, image, t, row_number() OVER (PARTITION BY u ORDER BY tm, n) AS mi, TRY_CAST(regexp_extract(t, '^(\\d{{1,3}})[.)]*$', 1) AS INT) AS c, CAST(n % 12 AS INT) AS cand_now,
  {{'idx': -1, 'err': n % 7 = 0, 'k': list_transform(f, lambda x: ['integer', 'date', 'text'][(n + x) % 3 + 1]), 'd': list_filter(f, lambda x: (n + x) % 3 = 0), 'code': CASE WHEN n % 2 = 0 THEN 'C-' || n % 50 END}} AS photo,
  CASE WHEN t IN ('?', '-') THEN ['integer', 'date', 'text'] ELSE list_filter(['integer', 'date', 'text'], lambda k: CASE k WHEN 'integer' THEN regexp_full_match(t, '\\d{{1,5}}( ans)?') WHEN 'date' THEN t = '3/4/2024' ELSE true END) END AS fits FROM e),
r AS (
 SELECT DISTINCT u, 0 AS i, CAST(NULL AS BIGINT) AS tm, 'idle' AS st, 0 AS rec, CAST([] AS STRUCT(idx INT, err BOOLEAN, k VARCHAR[], d BIGINT[], code VARCHAR)[]) AS pg, 0 AS cur, 0 AS edit, CAST(NULL AS VARCHAR) AS lab, 0 AS cand,
  CAST(NULL AS BIGINT) AS message_id, CAST(NULL AS VARCHAR) AS from_state, CAST(NULL AS VARCHAR) AS action, 0 AS page, 0 AS n_pages, 0 AS open_fields, CAST(NULL AS VARCHAR) AS command FROM e
 UNION ALL
 SELECT u, CAST(mi AS INT), mat, to_st, CASE WHEN act = 'page_saved' AND new_idx = 0 THEN rec + 1 ELSE rec END,
  CASE WHEN to_st = 'idle' THEN [] ELSE pg3 END, CASE WHEN to_st = 'idle' THEN 0 ELSE cur2 + CASE WHEN act = 'page_confirmed' THEN 1 ELSE 0 END END, CASE WHEN to_st = 'idle' THEN 0 WHEN act = 'value_wanted' THEN c ELSE edit0 END,
  CASE WHEN act = 'added_value_wanted' THEN t ELSE lab END, CASE WHEN act IN ('validated', 'dropped_and_validated') THEN least(cand_now, 8) ELSE cand END,
  n, st0, act, CASE WHEN len(pg3) > 0 AND st0 NOT IN ('idle', 'collecting') THEN cur2 + CASE WHEN act = 'page_confirmed' THEN 2 ELSE 1 END ELSE 0 END, CAST(len(pg3) AS INT), CASE WHEN len(pg3) > 0 AND st0 NOT IN ('idle', 'collecting') THEN CAST(len(pg3[cur2 + CASE WHEN act = 'page_confirmed' THEN 2 ELSE 1 END].d) AS INT) ELSE 0 END,
  CASE WHEN act = 'page_saved' THEN CASE WHEN new_idx = 0 THEN 'create_record' ELSE 'add_page ' || new_idx END WHEN act = 'page_replaced' THEN 'replace_page ' || p.idx
   WHEN act = 'code_set' THEN 'set_code ' || CASE WHEN sug IS NOT NULL AND c = 1 THEN sug ELSE t END WHEN act = 'page_dropped' THEN 'drop_page ' || p.idx WHEN act = 'dropped_and_validated' THEN 'drop_page ' || p.idx || '; validate'
   WHEN act = 'value_set' THEN 'set_field ' || p.idx || ' ' || edit0 WHEN act = 'field_added' THEN 'add_field ' || p.idx
   WHEN act = 'linked' THEN 'link ' || CASE WHEN c <= cand THEN 'EXISTING ' || c WHEN c = cand + 1 THEN 'CREATE' ELSE 'UNSURE' END
   WHEN st0 = 'confirm_uncertain' AND act = 'page_confirmed' THEN 'confirm_fields ' || p.idx WHEN st0 = 'confirm_uncertain' AND act = 'validated' THEN 'confirm_fields ' || p.idx || '; validate' WHEN act = 'validated' THEN 'validate' END
 FROM (
  SELECT *, CASE WHEN act IN ('page_dropped', 'dropped_and_validated') THEN least(cur0, len(pg0) - 2) ELSE cur0 END AS cur2,
   CASE WHEN act = 'page_saved' THEN list_append(pg0, {{'idx': new_idx, 'err': photo.err, 'k': photo.k, 'd': photo.d, 'code': photo.code}})
    WHEN act IN ('page_dropped', 'dropped_and_validated') THEN list_concat(pg0[1 : cur0], pg0[cur0 + 2 :])
    WHEN act = 'page_replaced' THEN list_concat(list_append(pg0[1 : cur0], {{'idx': p.idx, 'err': photo.err, 'k': photo.k, 'd': photo.d, 'code': photo.code}}), pg0[cur0 + 2 :])
    WHEN act = 'value_set' OR act = 'field_added' OR (st0 = 'confirm_uncertain' AND act IN ('page_confirmed', 'validated')) THEN list_concat(list_append(pg0[1 : cur0], {{'idx': p.idx, 'err': p.err, 'k': CASE WHEN act = 'field_added' THEN list_append(p.k, 'text') ELSE p.k END,
     'd': CASE WHEN act = 'field_added' THEN p.d WHEN act = 'value_set' THEN list_filter(p.d, lambda x: x <> edit0) ELSE CAST([] AS BIGINT[]) END, 'code': p.code}}), pg0[cur0 + 2 :]) ELSE pg0 END AS pg3,
   CASE act WHEN 'cancelled' THEN 'idle' WHEN 'page_saved' THEN 'collecting' WHEN 'collected' THEN 'ask_code' WHEN 'code_set' THEN 'review' WHEN 'page_replaced' THEN 'review' WHEN 'doubts_shown' THEN 'confirm_uncertain' WHEN 'fields_shown' THEN 'choose_field' WHEN 'photo_wanted' THEN 'retake'
    WHEN 'label_wanted' THEN 'add_label' WHEN 'value_wanted' THEN 'edit_value' WHEN 'added_value_wanted' THEN 'add_value' WHEN 'page_confirmed' THEN 'review' WHEN 'page_dropped' THEN 'review' WHEN 'value_set' THEN 'review' WHEN 'field_added' THEN 'review' WHEN 'field_refused' THEN 'review'
    WHEN 'back' THEN 'review' WHEN 'validated' THEN 'link' WHEN 'dropped_and_validated' THEN 'link' WHEN 'linked' THEN 'idle' ELSE st0 END AS to_st
  FROM (
   SELECT *, CASE WHEN image THEN CASE WHEN st0 IN ('idle', 'collecting') THEN CASE WHEN len(pg0) >= 10 THEN 'too_many_pages' ELSE 'page_saved' END WHEN st0 = 'retake' THEN 'page_replaced' WHEN st0 = 'ask_code' THEN 'code_first' ELSE 'busy' END
    WHEN t = '/aide' THEN 'helped' WHEN t = '/status' THEN 'status' WHEN t IN ('annuler', 'stop') THEN CASE WHEN st0 = 'idle' THEN 'nothing_to_cancel' ELSE 'cancelled' END WHEN t[1] = '/' THEN 'unknown_command'
    WHEN st0 = 'idle' THEN 'greeted' WHEN st0 = 'collecting' THEN CASE WHEN t = 'terminé' THEN 'collected' ELSE 'more_wanted' END
    WHEN st0 = 'ask_code' THEN CASE WHEN (sug IS NOT NULL AND c = 1) OR regexp_full_match(t, '[A-Za-z0-9][A-Za-z0-9 \\-_/]{{0,19}}') THEN 'code_set' ELSE 'bad_code' END
    WHEN st0 = 'review' AND failed THEN CASE WHEN c = 4 THEN 'photo_wanted' WHEN c = 5 AND len(pg0) > 1 THEN CASE WHEN NOT p.err THEN 'drop_refused' WHEN cur0 = len(pg0) - 1 THEN 'dropped_and_validated' ELSE 'page_dropped' END ELSE 'bad_choice' END
    WHEN st0 = 'review' THEN CASE c WHEN 1 THEN CASE WHEN len(p.d) > 0 THEN 'doubts_shown' WHEN cur0 + 1 < len(pg0) THEN 'page_confirmed' ELSE 'validated' END WHEN 2 THEN 'fields_shown' WHEN 3 THEN 'values_shown' WHEN 4 THEN 'photo_wanted' WHEN 5 THEN 'label_wanted' ELSE 'bad_choice' END
    WHEN st0 = 'confirm_uncertain' THEN CASE WHEN c = 1 THEN CASE WHEN cur0 + 1 < len(pg0) THEN 'page_confirmed' ELSE 'validated' END WHEN c = 2 THEN 'fields_shown' ELSE 'bad_choice' END
    WHEN st0 = 'choose_field' THEN CASE WHEN t = 'retour' THEN 'back' WHEN t = 'tout' THEN 'fields_shown' WHEN c BETWEEN 1 AND len(p.k) THEN 'value_wanted' ELSE 'bad_field' END
    WHEN st0 = 'edit_value' THEN CASE WHEN t = 'retour' THEN 'back' WHEN list_contains(fits, p.k[edit0]) THEN 'value_set' ELSE 'bad_value' END
    WHEN st0 = 'retake' THEN CASE WHEN t = 'retour' AND NOT p.err THEN 'back' ELSE 'photo_awaited' END
    WHEN st0 = 'add_label' THEN CASE WHEN t = 'retour' THEN 'back' WHEN length(t) >= 2 THEN 'added_value_wanted' ELSE 'bad_label' END
    WHEN st0 = 'add_value' THEN CASE WHEN t = 'retour' THEN 'back' WHEN lab IN ('Téléphone', 'CIN : AB123456') OR t = 'CIN : AB123456' THEN 'field_refused' ELSE 'field_added' END
    WHEN c BETWEEN 1 AND cand + 2 THEN 'linked' ELSE 'bad_choice' END AS act
   FROM (
    SELECT *, pg0[cur0 + 1] AS p, coalesce(pg0[cur0 + 1].err OR len(pg0[cur0 + 1].k) = 0, false) AS failed, list_filter(list_transform(pg0, lambda x: x.code), lambda x: x IS NOT NULL)[1] AS sug, CAST(coalesce(list_max(list_transform(pg0, lambda x: x.idx)), -1) + 1 AS INT) AS new_idx
    FROM (
     SELECT *, CASE WHEN stale THEN 'idle' ELSE st END AS st0, CASE WHEN stale THEN [] ELSE pg END AS pg0, CASE WHEN stale THEN 0 ELSE cur END AS cur0, CASE WHEN stale THEN 0 ELSE edit END AS edit0
     FROM (SELECT r.*, m.*, coalesce(mat - tm > 7200000000, false) AS stale FROM r JOIN m ON mu = u AND mi = i + 1)))))
),
steps AS (SELECT CAST(u AS VARCHAR) AS "user", message_id, from_state, action, st AS to_state, rec AS record_no, CAST(page AS INT) AS page, n_pages, open_fields, command FROM r WHERE i > 0)
"""


@query(_STEPS + "SELECT * FROM steps")
def chat_steps(spark, sf_dir):
    """What each message does in its user's conversation."""
    return chat.log(messages(spark, sf_dir))


@query(_STEPS + 'SELECT from_state, action, to_state, count(*) AS n, count(DISTINCT "user") AS n_users FROM steps GROUP BY ALL')
def chat_moves(spark, sf_dir):
    """How often each action is taken in each state, and by how many users."""
    return chat.log(messages(spark, sf_dir)).groupBy("from_state", "action", "to_state").agg(F.count("*").alias("n"), F.count_distinct("user").alias("n_users"))


@query(_STEPS + """
, s AS (SELECT * FROM steps WHERE record_no > 0 AND NOT (from_state = 'idle' AND to_state = 'idle'))
SELECT "user", record_no, count(*) AS n_messages, count(*) FILTER (command LIKE 'create%' OR command LIKE 'add_page%') AS n_pages, count(command) AS n_commands, coalesce(arg_max(action, message_id) FILTER (action IN ('linked', 'cancelled')), 'open') AS outcome FROM s GROUP BY ALL""")
def chat_records(spark, sf_dir):
    """The records that conversations opened, and how they ended."""
    return chat.records_of(chat.log(messages(spark, sf_dir)))


@query(_STEPS + """
, c AS (SELECT unnest(string_split(command, '; ')) AS c, action FROM steps WHERE command IS NOT NULL),
v AS (SELECT CASE WHEN c = 'create_record' THEN 'create' WHEN c LIKE 'set_field%' OR c LIKE 'confirm%' THEN 'review' ELSE split_part(c, ' ', 1) END AS verb FROM c WHERE c NOT LIKE 'add_field%'
 UNION ALL SELECT CASE WHEN message_id % 7 = 0 THEN 'failed' ELSE 'read' END FROM steps WHERE action IN ('page_saved', 'page_replaced'))
SELECT verb, 'done' AS verdict, count(*) AS n FROM v GROUP BY verb""")
def capture_flow(spark, sf_dir):
    """Conversations to commands to the record store: it carries out all that conversations ask for."""
    said = messages(spark, sf_dir)
    return commands.replayed(chat.commands_of(chat.log(said), said)).groupBy("verb", "verdict").agg(F.count("*").alias("n"))


_VERBS = ["create", "read", "read", "set_code", "validate", "link", "add_page", "failed", "retry", "replace_page", "drop_page", "review", "create", "read", "read", "validate", "link"]


def orders(spark, sf_dir: str):
    """Events as commands to three records of each user."""
    n = F.col("event_id")
    pick = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    verb = pick(_VERBS, n % 17)
    code = F.when(n % 10 == 0, " ").when(n % 11 == 0, F.repeat(F.lit("x"), 21)).otherwise(F.concat(F.lit(" p"), (n % 40).cast("string")))
    arg = (
        F.when(verb == "create", (F.floor(n / 3) % 4).cast("string")).when(verb == "read", F.when(F.floor(n / 7) % 3 == 0, "2").otherwise("0")).when(verb == "review", (F.floor(n / 5) % 2).cast("string"))
        .when(verb == "failed", F.concat(F.lit("E"), (n % 5).cast("string"))).when(verb == "set_code", code).when(verb == "link", pick(["CREATE", "UNSURE", "EXISTING", "NOBODY"], F.floor(n / 17) % 4))
    )
    return read(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id"), n % 3).alias("record_id"), n.alias("command_id"), verb.alias("verb"), (F.floor(n / 3) % 3).cast("int").alias("page_idx"), arg.alias("arg"))


_PAGE = "STRUCT(idx BIGINT, rd BOOLEAN, err VARCHAR, op INT)[]"
_REPLAYED = f"""
WITH RECURSIVE v AS (SELECT user_id || '-' || event_id % 3 AS rid, event_id AS n, {_sql_list(_VERBS)}[event_id % 17 + 1] AS verb, event_id // 3 % 3 AS pi FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n) AS ci, CASE verb WHEN 'create' THEN '' || n // 3 % 4 WHEN 'read' THEN CASE WHEN n // 7 % 3 = 0 THEN '2' ELSE '0' END WHEN 'review' THEN '' || n // 5 % 2 WHEN 'failed' THEN 'E' || n % 5
  WHEN 'set_code' THEN CASE WHEN n % 10 = 0 THEN '' WHEN n % 11 = 0 THEN repeat('X', 21) ELSE 'P' || n % 40 END WHEN 'link' THEN ['CREATE', 'UNSURE', 'EXISTING', 'NOBODY'][n // 17 % 4 + 1] END AS arg FROM v),
r AS (
 SELECT DISTINCT rid AS record_id, 0 AS i, CAST(NULL AS VARCHAR) AS st, CAST([] AS {_PAGE}) AS pg, CAST(NULL AS VARCHAR) AS code, false AS linked, CAST(NULL AS BIGINT) AS command_id, CAST(NULL AS VARCHAR) AS verb, CAST(NULL AS VARCHAR) AS verdict, CAST([] AS STRUCT(state VARCHAR, note VARCHAR)[]) AS ev FROM c
 UNION ALL
 SELECT record_id, CAST(ci AS INT), CASE WHEN len(ev2) > 0 THEN ev2[-1].state ELSE st END, pg2, CASE WHEN ok AND now = 'set_code' THEN arg ELSE code END, linked OR (ok AND now = 'link' AND arg <> 'UNSURE'), n, now, vd, ev2
 FROM (
  SELECT *, CAST(CASE WHEN NOT ok THEN [] WHEN now = 'create' THEN [{{'state': 'CAPTURED', 'note': NULL}}, {{'state': 'PENDING_AI', 'note': NULL}}]
   WHEN now = 'add_page' THEN CASE st WHEN 'PENDING_AI' THEN [] WHEN 'CAPTURED' THEN [{{'state': 'PENDING_AI', 'note': NULL}}] ELSE [{{'state': 'CAPTURED', 'note': 'ADD page ' || nx}}, {{'state': 'PENDING_AI', 'note': NULL}}] END
   WHEN now IN ('read', 'failed') THEN CASE WHEN st <> 'PENDING_AI' OR len(list_filter(pg2, lambda x: NOT x.rd AND x.err IS NULL)) > 0 THEN [] WHEN len(list_filter(pg2, lambda x: x.rd)) > 0 THEN [{{'state': 'AI_PROCESSED', 'note': NULL}}, {{'state': 'NEEDS_REVIEW', 'note': NULL}}] ELSE [{{'state': 'PROCESSING_FAILED', 'note': pg2[1].err}}] END
   WHEN now = 'retry' THEN [{{'state': 'PENDING_AI', 'note': 'RETRY'}}] WHEN now = 'replace_page' THEN [{{'state': 'CAPTURED', 'note': 'RETAKE page ' || pi}}, {{'state': 'PENDING_AI', 'note': NULL}}]
   WHEN now = 'drop_page' THEN [{{'state': st, 'note': 'DROP page ' || pi}}] WHEN now = 'set_code' THEN [{{'state': st, 'note': 'CODE'}}] WHEN now = 'validate' THEN [{{'state': 'VALIDATED', 'note': NULL}}]
   WHEN now = 'link' AND arg = 'UNSURE' THEN CASE WHEN st = 'VALIDATED' THEN [{{'state': 'SUSPECTED_DUPLICATE', 'note': NULL}}] ELSE [] END
   WHEN now = 'link' THEN [{{'state': 'PATIENT_LINKED', 'note': arg}}, {{'state': 'SAVED', 'note': NULL}}, {{'state': 'SYNCED', 'note': NULL}}] ELSE [] END AS STRUCT(state VARCHAR, note VARCHAR)[]) AS ev2
  FROM (
   SELECT *, CAST(CASE WHEN NOT ok THEN pg WHEN now = 'create' THEN list_transform(range(0, CAST(arg AS INT)), lambda k: {{'idx': k, 'rd': false, 'err': NULL, 'op': 0}}) WHEN now = 'add_page' THEN list_append(pg, {{'idx': nx, 'rd': false, 'err': NULL, 'op': 0}})
     WHEN now = 'retry' THEN list_transform(pg, lambda x: {{'idx': x.idx, 'rd': x.rd, 'err': NULL, 'op': x.op}}) WHEN now = 'drop_page' THEN list_filter(pg, lambda x: x.idx <> pi)
     WHEN now IN ('read', 'failed', 'replace_page', 'review') THEN list_transform(pg, lambda x: CASE WHEN x.idx <> pi THEN x ELSE {{'idx': x.idx, 'rd': now = 'read' OR (now <> 'replace_page' AND x.rd), 'err': CASE WHEN now = 'failed' THEN arg WHEN now = 'replace_page' THEN NULL ELSE x.err END, 'op': CASE WHEN now IN ('read', 'review') THEN CAST(arg AS INT) WHEN now = 'replace_page' THEN 0 ELSE x.op END}} END)
     ELSE pg END AS {_PAGE}) AS pg2
   FROM (
    SELECT *, vd = 'done' AS ok FROM (
     SELECT *, CASE WHEN now = 'create' THEN CASE WHEN st IS NULL THEN 'done' ELSE 'exists' END WHEN st IS NULL THEN 'no_record'
       WHEN now = 'add_page' THEN CASE WHEN st IN ('PENDING_AI', 'CAPTURED') OR again THEN 'done' ELSE 'closed' END
       WHEN now IN ('read', 'failed') THEN CASE WHEN p IS NULL THEN 'no_page' WHEN p.rd OR p.err IS NOT NULL THEN 'not_waiting' ELSE 'done' END
       WHEN now = 'retry' THEN CASE WHEN st IN ('CAPTURED', 'PROCESSING_FAILED') THEN 'done' ELSE 'refused' END WHEN now = 'replace_page' THEN CASE WHEN p IS NULL THEN 'no_page' WHEN again THEN 'done' ELSE 'refused' END
       WHEN now = 'drop_page' THEN CASE WHEN p IS NULL THEN 'no_page' WHEN p.rd THEN 'page_read' WHEN len(pg) = 1 THEN 'only_page' ELSE 'done' END
       WHEN now = 'set_code' THEN CASE WHEN length(arg) > 20 THEN 'code_too_long' WHEN arg = '' THEN 'code_empty' WHEN linked THEN 'patient_chosen' ELSE 'done' END
       WHEN now = 'review' THEN CASE WHEN p IS NULL THEN 'no_page' WHEN NOT p.rd THEN 'unread_page' ELSE 'done' END
       WHEN now = 'validate' THEN CASE WHEN bad IS NOT NULL THEN CASE WHEN bad.rd THEN 'open_fields' ELSE 'unread_page' END WHEN st IN ('NEEDS_REVIEW', 'MANUAL_REVIEW_REQUIRED') THEN 'done' ELSE 'refused' END
       WHEN code IS NULL THEN 'no_code' WHEN arg = 'UNSURE' THEN 'done' WHEN arg = 'NOBODY' THEN 'no_patient' WHEN st IN ('VALIDATED', 'SUSPECTED_DUPLICATE') THEN 'done' ELSE 'refused' END AS vd
     FROM (SELECT r.record_id, r.st, r.pg, r.code, r.linked, c.n, c.verb AS now, c.pi, c.ci, c.arg, list_filter(pg, lambda x: x.idx = c.pi)[1] AS p, list_filter(pg, lambda x: NOT x.rd OR x.op > 0)[1] AS bad, coalesce(list_max(list_transform(pg, lambda x: x.idx)), -1) + 1 AS nx,
       coalesce(st IN ('NEEDS_REVIEW', 'MANUAL_REVIEW_REQUIRED', 'PROCESSING_FAILED'), false) AS again FROM r JOIN c ON c.rid = r.record_id AND c.ci = r.i + 1))))))
"""


@query(_REPLAYED + "SELECT record_id, command_id, verb, verdict, st AS state, CAST(len(pg) AS INT) AS n_pages, code, linked FROM r WHERE i > 0")
def commands_replayed(spark, sf_dir):
    """Which commands are carried out, which are refused and why, and the records after them."""
    return commands.replayed(orders(spark, sf_dir)).drop("events")


@query(_REPLAYED + "SELECT record_id, command_id, CAST(k AS INT) AS place, ev[k + 1].state AS state, ev[k + 1].note AS note FROM (SELECT record_id, command_id, ev, unnest(range(0, len(ev))) AS k FROM r WHERE i > 0)")
def record_events(spark, sf_dir):
    """The event log that the commands leave."""
    return commands.events_of(commands.replayed(orders(spark, sf_dir)))


@query(_REPLAYED + "SELECT verb, verdict, count(*) AS n FROM r WHERE i > 0 GROUP BY ALL")
def verdicts_of_commands(spark, sf_dir):
    return commands.replayed(orders(spark, sf_dir)).groupBy("verb", "verdict").agg(F.count("*").alias("n"))


_SECRET = "a secret of the queries"
_PADS = {x: bytes(k ^ x for k in _SECRET.encode().ljust(64, b"\0")).hex() for x in (0x36, 0x5C)}


@query(f"""
SELECT event_id, ['ok', 'other_body', 'bad_signature', 'bad_algorithm', 'stale', 'bad_token', 'no_token', 'ok', 'stale'][event_id % 9 + 1] AS verdict,
 sha256(unhex('{_PADS[0x5C]}') || unhex(sha256(unhex('{_PADS[0x36]}') || encode('event ' || event_id)))) AS signature FROM events""")
def events_signed(spark, sf_dir):
    """Events as signed messages, some of them changed, old, badly signed or without a token; and the signature of a text."""
    n = F.col("event_id")
    kind = n % 9
    url = lambda b: F.translate(F.base64(b), "+/=\r\n", "-_")
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    body = F.concat(F.lit('{"id": '), n.cast("string"), F.lit(', "type": "'), "event_type", F.lit(' ok"}'))
    told = F.sha2(F.when(kind == 7, F.regexp_replace(F.regexp_replace(body, ": ", ":"), ", ", ",")).otherwise(body).cast("binary"), 256)
    made = F.unix_timestamp(now) - F.when(kind == 4, 3601).when(kind == 8, -3601).otherwise(n % 3600)
    head = url(F.when(kind == 3, '{"alg":"none"}').otherwise('{"alg":"HS256","typ":"JWT"}').cast("binary"))
    claims = url(F.concat(F.lit('{"iat":'), made.cast("string"), F.lit(',"payload_hash":"'), told, F.lit('"}')).cast("binary"))
    signature = lambda secret: url(F.unhex(hmac_sha256(secret, F.concat_ws(".", head, claims))))
    token = F.concat_ws(".", head, claims, F.when(kind != 5, F.when(kind == 2, signature("another")).otherwise(signature(_SECRET))))
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.when(kind == 1, F.concat(body, F.lit(" "))).otherwise(body).alias("body"), F.concat(F.when(kind == 6, "Basic ").otherwise("Bearer "), token).alias("authorization"), now.alias("received_at"))
    rows = rows.withColumn("body", F.when(F.col("event_id") % 9 == 1, F.replace("body", F.lit("ok"), F.lit("no"))).otherwise(F.col("body")))
    told_so = signed.verdict(F.col("body"), F.col("authorization"), F.col("received_at"), _SECRET)
    return rows.select("event_id", told_so.alias("verdict"), hmac_sha256(_SECRET, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("signature"))
