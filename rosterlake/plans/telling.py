"""Queries of the message operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import display as dp
from ..functions import reading as rd
from ..operators import forms as fm
from ..operators import layout as ly
from ..operators import lifecycle as lc
from ..operators import messages as ms
from ..operators import quality as ql
from . import register
from .catalog import query, read

_STATUS = ["KNOWN", "NEEDS_REVIEW", "NOT_PROVIDED", "UNKNOWN", "ILLEGIBLE", "KNOWN"]
_TYPES = ["accouchement", "grossesse_actuelle", "unknown", "identification_antecedents"]


def _pick(words, i):
    return F.get(F.array(*map(F.lit, words)), i.cast("int"))


def _fields(spark, sf_dir):
    """Lines as fields of the two pages of their order: labels by flag, sections by supplier, values by kind."""
    rows = read(spark, sf_dir, "lineitem")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    part, q, kind = F.col("l_partkey"), F.col("l_quantity").cast("int"), _pick(["text", "weight", "date", "checkbox", "weeks", "sex"], F.col("n") % 6)
    value = (
        F.when(kind == "text", F.concat(F.lit("v"), part.cast("string"))).when(kind == "weight", (q * 1000 + 500).cast("string")).when(kind == "date", F.concat(F.lit("2024-05-"), F.lpad((part % 28 + 1).cast("string"), 2, "0")))
        .when(kind == "checkbox", "true").when(kind == "weeks", q.cast("string")).otherwise(F.when(part % 2 == 0, "F").otherwise("M"))
    )
    label = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("HTA | c"), (part % 4).cast("string"))).when(F.col("l_returnflag") == "N", F.concat(F.lit("Diabète | c"), (part % 4).cast("string"))).when(part % 9 > 0, F.concat(F.lit("Champ "), (part % 20).cast("string")))
    return rows.select(
        F.col("l_orderkey").alias("record_id"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("page_idx"), F.col("n").alias("ordinal"), F.concat(F.lit("cle_"), (part % 20).cast("string")).alias("key"), label.alias("label"), kind.alias("kind"),
        _pick(["Suivi", "", "Examens"], F.col("l_suppkey") % 3).alias("section"), F.when(part % 7 > 0, value).alias("value"), _pick(_STATUS, part % 6).alias("status"), _pick(["AI", "CORRECTED", "MANUAL", "AI"], part % 4).alias("origin"),
        _pick(["incoherent", "valeur_douteuse", "autre"], part % 3).alias("reason"), F.when(part % 5 == 0, F.concat(F.lit("alerte "), part.cast("string"))).alias("alert"),
    )


def _pages(spark, sf_dir):
    """Two pages of each order; of every fifth order the second could not be read."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page_idx"))
    bad = (F.col("record_id") % 5 == 0) & (F.col("page_idx") == 1)
    return rows.withColumns({"page_type": _pick(_TYPES, (F.col("record_id") + F.col("page_idx")) % 4), "title": F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("Titre "), (F.col("record_id") % 10).cast("string"))), "error": F.when(bad, "floue")})


_FIELDS = """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal FROM lineitem),
f0 AS (SELECT l_orderkey AS record_id, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS page_idx, ordinal, l_partkey AS part, CAST(l_quantity AS INT) AS q, ['text', 'weight', 'date', 'checkbox', 'weeks', 'sex'][ordinal % 6 + 1] AS kind,
 coalesce(CASE l_returnflag WHEN 'A' THEN 'HTA | c' || l_partkey % 4 WHEN 'N' THEN 'Diabète | c' || l_partkey % 4 ELSE CASE WHEN l_partkey % 9 > 0 THEN 'Champ ' || l_partkey % 20 END END, 'Cle ' || l_partkey % 20) AS name,
 ['Suivi', '', 'Examens'][l_suppkey % 3 + 1] AS section, ['KNOWN', 'NEEDS_REVIEW', 'NOT_PROVIDED', 'UNKNOWN', 'ILLEGIBLE', 'KNOWN'][l_partkey % 6 + 1] AS status, l_partkey % 4 IN (1, 2) AS edited,
 ['ne colle pas avec le reste du registre', 'lecture incertaine', NULL][l_partkey % 3 + 1] AS why, CASE WHEN l_partkey % 5 = 0 THEN 'alerte ' || l_partkey END AS alert FROM l),
f1 AS (SELECT *, status IN ('NEEDS_REVIEW', 'ILLEGIBLE') AS doubt, status <> 'NOT_PROVIDED' AS shown, CASE WHEN status = 'UNKNOWN' THEN 'Inconnu' WHEN status = 'ILLEGIBLE' THEN 'illisible' WHEN status = 'NOT_PROVIDED' OR part % 7 = 0 THEN CASE WHEN status = 'NEEDS_REVIEW' THEN '?' ELSE '—' END
  WHEN kind = 'text' THEN 'v' || part WHEN kind = 'weight' THEN CASE WHEN q * 1000 + 500 >= 10000 THEN q || ',5 kg' ELSE (q * 1000 + 500) || ' g' END WHEN kind = 'date' THEN lpad('' || (part % 28 + 1), 2, '0') || '/05/2024' WHEN kind = 'checkbox' THEN 'Oui' WHEN kind = 'weeks' THEN q || ' SA' WHEN part % 2 = 0 THEN 'Féminin' ELSE 'Masculin' END AS told,
 min(ordinal) OVER (PARTITION BY record_id, page_idx, section) AS begins FROM f0),
f AS (SELECT *, row_number() OVER (PARTITION BY record_id, page_idx ORDER BY begins, ordinal) AS number, CASE WHEN contains(name, ' | ') THEN split_part(name, ' | ', 1) END AS row, CASE WHEN doubt THEN '⚠️ ' ELSE '' END AS flag, CASE WHEN edited THEN ' ✏️' ELSE '' END AS pen FROM f1),
s AS (SELECT *, lag(section) OVER w AS before, CASE WHEN lag(section) OVER w = section AND lag(row) OVER w = row THEN 0 ELSE 1 END AS new FROM f WHERE shown WINDOW w AS (PARTITION BY record_id, page_idx ORDER BY number)),
g AS (SELECT *, sum(new) OVER (PARTITION BY record_id, page_idx ORDER BY number ROWS UNBOUNDED PRECEDING) AS run FROM s),
r AS (SELECT record_id, page_idx, run, CASE WHEN count(*) > 1 THEN any_value(row) || ' : ' || string_agg(number || '. ' || flag || split_part(name, ' | ', 2) || ' *' || told || '*' || pen, ' · ' ORDER BY number) ELSE any_value(number || '. ' || flag || name || ' : *' || told || '*' || pen) END AS line,
 max(CASE WHEN section <> '' AND before IS DISTINCT FROM section THEN chr(10) || '*' || section || '*' || chr(10) ELSE '' END) AS head FROM g GROUP BY ALL),
v AS (SELECT record_id, page_idx, trim(string_agg(head || line, chr(10) ORDER BY run), chr(10)) AS text FROM r GROUP BY ALL)
"""


@query(_FIELDS + """,
p AS (SELECT o_orderkey AS record_id, page_idx, CASE WHEN o_orderkey % 5 = 0 AND page_idx = 1 THEN 'floue' END AS error, coalesce(['Accouchement', 'Grossesse actuelle', NULL, 'Identification et antécédents'][(o_orderkey + page_idx) % 4 + 1], CASE WHEN o_orderkey % 2 = 0 THEN 'Titre ' || o_orderkey % 10 END, 'Page') AS name FROM orders, (VALUES (0), (1)) AS x(page_idx)),
c AS (SELECT record_id, page_idx, count(*) FILTER (shown) AS n_shown, count(*) FILTER (doubt) AS n_doubts, array_to_string((list(number || '. ' || name ORDER BY number) FILTER (doubt))[:5], ', ') AS five,
 array_to_string((list('• ' || number || '. ' || name || ' : *' || told || '*' || coalesce(' (' || why || ')', '') || coalesce(chr(10) || '   ↳ ' || alert, '') ORDER BY number) FILTER (doubt))[:15], chr(10)) AS fifteen FROM f GROUP BY ALL)
SELECT record_id, page_idx, CASE WHEN error IS NULL AND n_shown IS NOT NULL THEN coalesce(text, 'Aucune valeur lue sur cette page.') END AS values_text,
 CASE WHEN error IS NOT NULL OR n_shown IS NULL THEN '❌ *Page ' || (page_idx + 1) || '/2 · lecture impossible*' || chr(10) || coalesce(error, 'Raison inconnue.') || chr(10) || chr(10) || '👇 Reprendre la photo, ou ignorer cette page ?'
  ELSE '📄 *Page ' || (page_idx + 1) || '/2 · ' || name || '*' || chr(10) || '📊 ' || n_shown || ' valeur(s) lue(s)' || chr(10) || CASE WHEN n_doubts > 0 THEN '⚠️ ' || n_doubts || ' à vérifier : ' || five || CASE WHEN n_doubts > 5 THEN ' (+' || (n_doubts - 5) || ')' ELSE '' END ELSE '✅ Aucune incertitude restante.' END || chr(10) || chr(10) || '👇 Que voulez-vous faire ?' END AS review_text,
 CASE WHEN error IS NULL AND n_doubts > 0 THEN '⚠️ *' || n_doubts || ' valeur(s) restent à vérifier :*' || chr(10) || fifteen || chr(10) || chr(10) || '👇 Vous les avez vérifiées sur le registre ? Confirmez-les telles quelles, ou corrigez.' END AS doubts_text
FROM p LEFT JOIN c USING (record_id, page_idx) LEFT JOIN v USING (record_id, page_idx)""")
def page_messages(spark, sf_dir):
    """What is told of each page: its values, what is to be checked, or why it could not be read."""
    return ms.page_messages(_fields(spark, sf_dir), _pages(spark, sf_dir))


@query(_FIELDS + """,
p AS (SELECT o_orderkey AS record_id, page_idx, coalesce(['Accouchement', 'Grossesse actuelle', NULL, 'Identification et antécédents'][(o_orderkey + page_idx) % 4 + 1], CASE WHEN o_orderkey % 2 = 0 THEN 'Titre ' || o_orderkey % 10 END, 'Page') AS name FROM orders, (VALUES (0), (1)) AS x(page_idx))
SELECT record_id, '✅ *Registre enregistré* · code C' || o_custkey || ' · 2 page(s)' || chr(10) || string_agg(chr(10) || '📄 *Page ' || (page_idx + 1) || ' · ' || name || '*' || chr(10) || coalesce(text, 'Aucune valeur lue sur cette page.'), chr(10) ORDER BY page_idx)
 || chr(10) || chr(10) || '🗂️ Résultat final enregistré (dossier ' || record_id || '), visible sur le tableau de bord.' AS text FROM p LEFT JOIN v USING (record_id, page_idx) JOIN orders ON o_orderkey = record_id GROUP BY record_id, o_custkey""")
def final_messages(spark, sf_dir):
    """What is told once a record is kept."""
    records = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"))
    return ms.final_texts(records, _pages(spark, sf_dir), _fields(spark, sf_dir))


@query("""
WITH c AS (SELECT o_orderkey AS record_id, 'P' || l_partkey AS patient_code, list_filter([CASE WHEN l_linenumber = 1 THEN 'même code' END, CASE WHEN l_returnflag = 'R' THEN 'même âge' END, CASE WHEN l_linestatus = 'F' THEN 'AUTRE' END], lambda x: x IS NOT NULL) AS why,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rank FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
t AS (SELECT record_id, string_agg(rank || '️⃣' || ' ' || patient_code || CASE WHEN len(why) > 0 THEN ' · ' || array_to_string(why, ', ') ELSE '' END, chr(10) ORDER BY rank) AS lines FROM c WHERE rank <= 8 GROUP BY 1)
SELECT o_orderkey AS record_id, CASE WHEN lines IS NULL THEN '👤 Aucune patiente suivie avec le code *C' || o_custkey || '*.' || chr(10) || chr(10) || '👇 Créer la patiente, ou décider plus tard sur le tableau de bord ?'
 ELSE '👤 *Ce registre (C' || o_custkey || ') est-il celui d''une patiente déjà suivie ?*' || chr(10) || chr(10) || lines || chr(10) || chr(10) || '👇 Choisissez la patiente, une nouvelle patiente, ou « Je ne sais pas ».' END AS text FROM orders LEFT JOIN t ON record_id = o_orderkey""")
def link_messages(spark, sf_dir):
    """Which patients a record may belong to, the first eight, with reasons."""
    lines = read(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber"))
    reasons = F.array_compact(F.array(F.when(F.col("l_linenumber") == 1, "SAME_CODE"), F.when(F.col("l_returnflag") == "R", "SAME_AGE"), F.when(F.col("l_linestatus") == "F", "AUTRE")))
    candidates = lines.select(F.col("l_orderkey").alias("record_id"), rank.alias("rank"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("patient_code"), reasons.alias("reasons"))
    records = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"))
    return ms.link_texts(records, candidates)


_DAY = lambda c: f"strftime(CAST({c} AS DATE), '%d/%m/%Y')"
_NUM = lambda c: f"replace(regexp_replace(printf('%.1f', CAST({c} AS DOUBLE)), '\\.0$', ''), '.', ',')"


@query(register.ALERTS + f""",
shown AS (SELECT *, CASE measure WHEN 'bp' THEN sys || '/' || dia ELSE {_NUM("num")} END AS t FROM s WHERE measure IN ('weight', 'bp')),
near AS (SELECT record_id, key, t, lag(t) OVER w AS before, lead(t) OVER w AS after FROM shown WINDOW w AS (PARTITION BY record_id, measure ORDER BY col)),
texts AS (
 SELECT record_id, 0 AS page_idx, key, 'format' AS code, CASE measure WHEN 'bp' THEN 'TA ' || sys || '/' || dia || ' : chiffres impossibles pour une tension' WHEN 'gaWeeks' THEN 'Âge gestationnel ' || CAST(num AS INT) || ' SA : valeur impossible' ELSE 'Poids ' || {_NUM("num")} || ' : valeur impossible pour ce champ' END AS text FROM s
 UNION ALL SELECT record_id, 0, key, 'bp_order', 'TA ' || sys || '/' || dia || ' : le 1er chiffre devrait être le plus grand' FROM s WHERE measure = 'bp'
 UNION ALL SELECT record_id, 0, date_key, 'future', 'Date ' || {_DAY("day")} || ' : dans le futur' FROM y
 UNION ALL SELECT record_id, 0, appointment_key, 'appointment_before_visit', 'Rendez-vous ' || {_DAY("app")} || ' : avant la visite du ' || {_DAY("day")} FROM y
 UNION ALL SELECT record_id, 0, ga_key, 'ga_lmp', gaWeeks || ' SA lu : la DDR (' || {_DAY("lmp")} || ') et la date de venue (' || {_DAY("day")} || ') donnent environ ' || CAST(round_even(date_diff('day', lmp, day) / 7.0, 0) AS INT) || ' SA' FROM y
 UNION ALL SELECT record_id, 0, date_key, 'date_order', 'Venue le ' || {_DAY("day")} || ' : pas après la visite précédente (' || {_DAY("pday")} || ')' FROM dw WHERE bad
 UNION ALL SELECT record_id, 0, ga_key, 'ga_dates', gaWeeks || ' SA lu : ' || CAST(round_even(date_diff('day', pday, day) / 7.0, 0) AS INT) || ' semaines après la visite à ' || pga || ' SA' FROM de
 UNION ALL SELECT near.record_id, 0, near.key, 'spike', CASE measure WHEN 'bp' THEN 'TA ' ELSE 'Poids ' END || t || ' : très loin des visites voisines (' || before || ' et ' || after || ')' FROM near JOIN s USING (record_id, key)
 UNION ALL SELECT record_id, 2, unnest(['parite', 'gestation']), 'parity_gravidity', 'Parité ' || pa || ' plus grande que la gestité ' || gr FROM h
 UNION ALL SELECT record_id, 2, unnest(['obst_avortement_nombre', 'gestation']), 'obstetric_sum', 'Parité ' || pa || ' + avortements ' || ab || ' dépassent la gestité ' || gr FROM h
 UNION ALL SELECT record_id, 2, 'enfants_vivants', 'living_parity', living || ' enfants vivants pour une parité de ' || pa || ' (naissances multiples ?)' FROM h
 UNION ALL SELECT record_id, 2, 'parite', 'deliveries_parity', told || ' accouchements antérieurs décrits pour une parité de ' || pa FROM h
 UNION ALL SELECT record_id, 1, unnest(['mode_voie_basse_instrumentale', 'mode_cesarienne_urgence']), 'two_modes', 'Voie basse et césarienne cochées ensemble' FROM o
 UNION ALL SELECT record_id, 0, unnest(['dpa', 'ddr']), 'edd_lmp', 'DPA ' || {_DAY("began + 290")} || ' : la DDR (' || {_DAY("began")} || ') donne le ' || {_DAY("began + 280")} FROM o
 UNION ALL SELECT record_id, 1, 'nn_age_gestationnel', 'birth_ga', '34 SA à la naissance : la DDR (' || {_DAY("began")} || ') et la date d''accouchement donnent environ 38 SA' FROM o)
SELECT DISTINCT r.record_id, r.page_idx, r.key, r.code, t.text || ' : à vérifier sur le papier.' AS text FROM r JOIN texts t USING (record_id, page_idx, key, code)""")
def alert_messages(spark, sf_dir):
    """Alerts in words."""
    found = ql.check(register.fields(spark, sf_dir), register.AS_OF)
    return found.select("record_id", "page_idx", "key", "code", ms.alert_text(F.col("code"), F.col("params")).alias("text"))


@query()
def labels_judged(spark, sf_dir):
    """Names of parts as labels, some misread by a letter or two, against the words of the names of two brands. SQL has no such ratio; the tests hold it against difflib."""
    part = read(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit(" zorglub"))).when(F.col("p_partkey") % 4 == 2, F.translate("p_name", "ae", "o")).when(F.col("p_partkey") % 4 == 3, F.concat(F.lit("N° "), "p_name", F.lit(" (kg)"))).otherwise(F.col("p_name"))
    words = part.where("p_brand in ('Brand#1', 'Brand#2')").select(F.explode(F.split("p_name", " ")).alias("word"))
    return rd.label_reasons(part.select("p_partkey", name.alias("label")), words)


@query("SELECT count(*) FILTER (o_orderstatus IN ('O', 'P')) AS n_waiting FROM orders")
def records_waiting(spark, sf_dir):
    """Records whose next step needs the network."""
    status = F.col("o_orderstatus")
    return lc.waiting_for_network(read(spark, sf_dir, "orders").select(F.when(status == "O", "SYNC_FAILED").when(status == "P", "PENDING_AI").otherwise("SYNCED").alias("state")))


@query("""
WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ': ' || p_size WHEN 1 THEN ' ' || p_brand WHEN 2 THEN p_type ELSE ' ; ' || p_type END AS text, (p_partkey % 97) / 100.0::DOUBLE AS share FROM part),
c AS (SELECT *, length(text) AS n, length(regexp_extract(text, '^[^:;]*[:;]')) AS colon, CAST(round_even(share * length(text), 0) AS INT) AS mid, list_filter(range(0, length(text)), lambda i: text[i + 1] = ' ') AS spaces FROM t),
d AS (SELECT *, list_sort(list_transform(spaces, lambda i: {'d': abs(i - mid), 'i': i}))[1] AS near FROM c),
e AS (SELECT *, CASE WHEN colon > 0 THEN colon WHEN near.d <= 3 THEN near.i + 1 ELSE mid END AS cut FROM d),
f AS (SELECT *, trim(substr(text, 1, cut)) AS label, trim(substr(text, cut + 1)) AS value FROM e)
SELECT p_partkey, CASE WHEN ok THEN label END AS label, CASE WHEN ok THEN value END AS value FROM (SELECT *, n >= 4 AND share BETWEEN 0.2 AND 0.85 AND length(label) >= 2 AND length(value) >= CASE WHEN colon > 0 THEN 1 ELSE 2 END AS ok FROM f)""")
def lines_split(spark, sf_dir):
    """Lines of print and handwriting cut in two, where they can be."""
    part = read(spark, sf_dir, "part")
    n = F.col("p_partkey")
    text = F.concat("p_name", F.when(n % 4 == 0, F.concat(F.lit(": "), F.col("p_size").cast("string"))).when(n % 4 == 1, F.concat(F.lit(" "), "p_brand")).when(n % 4 == 2, F.col("p_type")).otherwise(F.concat(F.lit(" ; "), "p_type")))
    return part.select("p_partkey", ly.split_mixed(text, (n % 97) / 100.0).alias("s")).select("p_partkey", "s.label", "s.value")


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Second reading of ' || event_id % 9 || ' doubtful or unlinked value(s) by m' || user_id WHEN 1 THEN 'PaddleOCR failed: ' || event_type WHEN 2 THEN 'model m' || user_id || ' missing (run `ollama pull m' || user_id || '`)'
 WHEN 3 THEN 'Reading the text (PaddleOCR) · Tables, checkboxes, labels' ELSE 'Autre message ' || event_id END AS message FROM events""")
def messages_translated(spark, sf_dir):
    """Messages of the reading steps in English; others stay as they are."""
    n, user = F.col("event_id"), F.concat(F.lit("m"), F.col("user_id").cast("string"))
    message = (
        F.when(n % 5 == 0, F.concat(F.lit("Relecture de "), (n % 9).cast("string"), F.lit(" valeur(s) douteuse(s) ou non rattachée(s) par "), user)).when(n % 5 == 1, F.concat(F.lit("PaddleOCR a échoué : "), "event_type"))
        .when(n % 5 == 2, F.concat(F.lit("modèle "), user, F.lit(" absent (lancer `ollama pull "), user, F.lit("`)"))).when(n % 5 == 3, "Lecture du texte (PaddleOCR) · Tableaux, cases à cocher, étiquettes").otherwise(F.concat(F.lit("Autre message "), n.cast("string")))
    )
    return read(spark, sf_dir, "events").select("event_id", dp.translated(message).alias("message"))


_LABELS, _ANSWERS = ["Groupe sanguin", "x", "Téléphone", "Poids", "Date du test", "Groupe  sanguin ", "Nombre de tests"], ["62,5 kg", "", "?", "3/4/2024", "12"]


@query("""
WITH q AS (SELECT user_id AS record_id, event_id AS tm, ['Groupe sanguin', 'x', 'Téléphone', 'Poids', 'Date du test', 'Groupe sanguin', 'Nombre de tests'][event_id % 7 + 1] AS label, ['62,5 kg', '', '?', '3/4/2024', '12'][event_id % 5 + 1] AS text FROM events),
b AS (SELECT *, CASE label WHEN 'x' THEN 'too_short' WHEN 'Téléphone' THEN 'personal' END AS refused, CASE label WHEN 'Groupe sanguin' THEN 'groupe_sanguin' WHEN 'Poids' THEN 'poids' WHEN 'Date du test' THEN 'date_du_test' WHEN 'Nombre de tests' THEN 'nombre_de_tests' END AS base FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY record_id, base ORDER BY tm) AS nth, CASE label WHEN 'Poids' THEN 'weight' WHEN 'Date du test' THEN 'date' WHEN 'Nombre de tests' THEN 'integer' ELSE 'text' END AS k FROM b)
SELECT record_id, 0 AS page_idx, tm AS "at", label, refused, CASE WHEN base IS NOT NULL THEN base || repeat('_', CAST(CASE WHEN base = 'poids' AND record_id % 2 = 0 THEN nth WHEN base = 'groupe_sanguin' AND record_id % 3 = 0 AND nth >= 2 THEN nth ELSE nth - 1 END AS INT)) END AS key, CASE WHEN base IS NOT NULL THEN k END AS kind,
 CASE WHEN base IS NULL OR text IN ('', '?') THEN NULL WHEN k = 'weight' THEN CASE text WHEN '62,5 kg' THEN '62500' WHEN '3/4/2024' THEN '3000' ELSE '12' END WHEN k = 'date' AND text = '3/4/2024' THEN '2024-04-03' WHEN k = 'integer' AND text = '3/4/2024' THEN '3' ELSE text END AS value,
 CASE WHEN base IS NULL THEN NULL WHEN text = '' THEN 'NOT_PROVIDED' WHEN text = '?' THEN 'UNKNOWN' ELSE 'KNOWN' END AS status FROM n""")
def fields_added(spark, sf_dir):
    """Fields that users add by label and text: refused ones, keys that are taken, values by the label's kind."""
    events = read(spark, sf_dir, "events")
    pick = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    requests = events.select(F.col("user_id").alias("record_id"), F.lit(0).alias("page_idx"), F.col("event_id").alias("at"), pick(_LABELS, F.col("event_id") % 7).alias("label"), pick(_ANSWERS, F.col("event_id") % 5).alias("text"))
    users = events.select(F.col("user_id").alias("record_id"), F.lit(0).alias("page_idx")).distinct()
    there = users.where("record_id % 2 = 0").withColumn("key", F.lit("poids")).union(users.where("record_id % 3 = 0").withColumn("key", F.lit("groupe_sanguin_")))
    return lc.added_fields(requests, there)


@query("""
WITH f AS (SELECT l_orderkey AS record_id, ['Suivi', '', 'Examens'][l_suppkey % 3 + 1] AS section, ['KNOWN', 'NEEDS_REVIEW', 'NOT_PROVIDED', 'UNKNOWN', 'ILLEGIBLE', 'KNOWN'][l_partkey % 6 + 1] AS status, l_partkey % 4 IN (1, 2) AS edited FROM lineitem),
s AS (SELECT *, CASE WHEN status IN ('NEEDS_REVIEW', 'ILLEGIBLE') THEN 'review' WHEN status = 'NOT_PROVIDED' THEN 'empty' WHEN edited THEN 'edited' ELSE 'known' END AS s FROM f)
SELECT record_id, section, count_if(s = 'known') AS known, count_if(s = 'review') AS review, count_if(s = 'edited') AS edited, count_if(s = 'empty') AS empty, count(*) AS total FROM s GROUP BY ALL""")
def sections_counted(spark, sf_dir):
    """Fields of each record's sections by what became of them."""
    return fm.section_counts(_fields(spark, sf_dir))


@query("""
WITH f AS (SELECT l_orderkey, l_linestatus, ['KNOWN', 'NEEDS_REVIEW', 'NOT_PROVIDED', 'UNKNOWN', 'ILLEGIBLE', 'KNOWN'][l_partkey % 6 + 1] AS status, l_partkey % 4 IN (0, 3) AS ai FROM lineitem)
SELECT count(DISTINCT (l_orderkey, l_linestatus)) AS pages_read, CAST(floor(100.0 * count_if(ai AND status = 'KNOWN') / count_if(status <> 'NOT_PROVIDED') + 0.5) AS INT) AS auto_read_percent, count_if(NOT ai) AS human_checked FROM f""")
def reading_quality(spark, sf_dir):
    """How well pages are read without help."""
    return fm.reading_quality(_fields(spark, sf_dir))


@query("""
WITH f AS (SELECT l_orderkey AS record_id, ['KNOWN', 'NEEDS_REVIEW', 'NOT_PROVIDED', 'UNKNOWN', 'ILLEGIBLE', 'KNOWN'][l_partkey % 6 + 1] AS status FROM lineitem),
o AS (SELECT record_id, count_if(status IN ('NEEDS_REVIEW', 'ILLEGIBLE')) AS open_fields FROM f GROUP BY 1)
SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS unread_pages, coalesce(open_fields, 0) AS open_fields FROM orders LEFT JOIN o ON record_id = o_orderkey WHERE o_orderkey % 5 = 0 OR open_fields > 0""")
def records_blocked(spark, sf_dir):
    """Records that may not be validated yet: pages without a reading, fields that ask for a look."""
    pages = _pages(spark, sf_dir).select("record_id", F.col("error").isNull().alias("fields_read"))
    return lc.validation_blockers(pages, _fields(spark, sf_dir))
