"""Queries of names, turns, texts and displays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions import text as X
from tandem.operators import shape as H
from tandem.operators import similarity as M
from tandem.plans.base import conversations, folder, longs, put, query
from tandem.plans.views import view
from tandem.sources import io

NAMES = "n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('convo_m', lang, '_', lang, '_20260127-143052.jsonl') WHEN 1 THEN concat('label_recovery_j-', source, '_', lang, '_20260127-143052.jsonl') WHEN 2 THEN concat('combined_', lang, '.json') WHEN 3 THEN concat('out/judge_', lang, '_x.jsonl') ELSE 'plain' END AS name, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'fi' END AS meta FROM documents)"


@query(rf"""WITH {NAMES}, f AS (SELECT *, nullif(regexp_extract(name, '^convo_.+_([a-z]{{2}}(?:-[a-z]{{2}})?)_\d{{8}}-\d{{6}}\.jsonl$', 1), '') AS file_language FROM n)
SELECT doc_id, file_language, nullif(regexp_extract(name, 'label_recovery_(.+?)_([a-z]{{2}})_\d{{8}}-\d{{6}}\.jsonl', 1), '') AS judge,
coalesce(nullif(regexp_extract(name, 'combined_([a-z]{{2}})\.json', 1), ''), nullif(regexp_extract(name, '[_-]([a-z]{{2}})[_.]', 1), ''), 'unknown') AS source_language,
coalesce(file_language, nullif(meta, ''), 'unknown') AS language, coalesce(nullif(meta, ''), file_language, 'unknown') AS meta_language,
CASE WHEN starts_with(name, 'combined_') THEN substr(name, 10) ELSE 'unknown' END AS stem, format('{{}}_{{}}_{{}}_{{:04d}}', name, coalesce(meta, 'x'), 'd', doc_id) AS conversation FROM f""")
def prj_file_names(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    k = F.col("doc_id") % 5
    stamp = F.lit("_20260127-143052.jsonl")
    name = F.when(k == 0, F.concat(F.lit("convo_m"), "lang", F.lit("_"), "lang", stamp)).when(k == 1, F.concat(F.lit("label_recovery_j-"), "source", F.lit("_"), "lang", stamp)).when(k == 2, F.concat(F.lit("combined_"), "lang", F.lit(".json"))).when(k == 3, F.concat(F.lit("out/judge_"), "lang", F.lit("_x.jsonl"))).otherwise("plain")
    d = d.select("doc_id", name.alias("name"), F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "fi").alias("meta"))
    n, m = F.col("name"), F.col("meta")
    return d.select("doc_id", X.file_language(n).alias("file_language"), X.judge_of_file(n).alias("judge"), X.source_language(n, n).alias("source_language"), X.language_of(n, m).alias("language"), X.language_of(n, m, True).alias("meta_language"), X.combined_stem(n).alias("stem"), X.conversation_name(n, F.coalesce(m, F.lit("x")), F.lit("d"), F.col("doc_id")).alias("conversation"))


SPOKEN = "s AS (SELECT conv_id, turn, role, CASE conv_id % 7 WHEN 0 THEN 'Teenindaja Mari' WHEN 1 THEN 'Klient Agentov' WHEN 2 THEN 'Asiakas' WHEN 3 THEN 'AGENTTI 1' WHEN 4 THEN 'ÜGYFÉL' WHEN 5 THEN 'Ügynök' ELSE 'Mari' END AS speaker, CASE WHEN turn % 2 = 0 THEN role END AS kind FROM conversations)"


def _has(words):
    return "(" + " OR ".join(f"contains(lower(speaker), '{w}')" for w in words) + ")"


def _role_sql(language):
    p = X.PROFILES[language]
    return f"CASE WHEN flag THEN 'agent' WHEN NOT flag THEN 'client' WHEN {_has(p.agent)} THEN 'agent' WHEN {_has(p.client)} THEN 'client' END AS {language}"


@query(f"WITH {SPOKEN}, f AS (SELECT *, CASE WHEN kind IN ('agent', 'assistant') THEN true WHEN kind IN ('customer', 'user') THEN false END AS flag FROM s) SELECT conv_id, turn, flag AS is_agent, {', '.join(map(_role_sql, X.PROFILES))} FROM f")
def prj_turn_roles(spark, sf):
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    names = ("Teenindaja Mari", "Klient Agentov", "Asiakas", "AGENTTI 1", "ÜGYFÉL", "Ügynök", "Mari")
    speaker = F.element_at(F.array(*map(F.lit, names)), (F.col("conv_id") % 7 + 1).cast("int"))
    flag = X.is_agent(F.when(F.col("turn") % 2 == 0, F.col("role")))
    return t.select("conv_id", "turn", flag.alias("is_agent"), *(X.role(speaker, flag, p).alias(language) for language, p in X.PROFILES.items()))


BLANKED = "b AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 6 = 0 THEN ' ' || chr(9) || chr(10) WHEN (conv_id + turn) % 6 = 1 THEN NULL ELSE text END AS text, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN NULL ELSE role END AS name FROM turns), k AS (SELECT *, coalesce(nullif(name, ''), 'Unknown') AS speaker FROM b WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10)) <> '')"


def _blanked(spark, sf):
    c = conversations(spark, sf)
    at = lambda m, i: F.col("conversation_id") + i
    changed = F.transform("messages", lambda m, i: m.withField("message", F.when(at(m, i) % 6 == 0, " \t\n").when(at(m, i) % 6 != 1, m["message"])).withField("from_name", F.when(i % 3 == 0, "").when(i % 3 != 1, m["from_name"])))
    return c.withColumn("messages", changed)


_PLACED = BLANKED.replace("FROM turns)", "FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM turns))")


@query(f"WITH {_PLACED} SELECT conv_id AS conversation_id, count(*) AS n, string_agg(speaker || '=' || text, chr(10) ORDER BY turn) AS messages FROM k GROUP BY conv_id", "turns")
def prj_drop_blank(spark, sf):
    found = H.drop_blank(_blanked(spark, sf)).where(F.size("messages") > 0)
    return found.select("conversation_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat(m["from_name"], F.lit("="), m["message"])), "\n").alias("messages"))


@query(f"WITH {_PLACED} SELECT conv_id AS conversation_id, chr(10) || string_agg(speaker || ': ' || text, chr(10) ORDER BY turn) || chr(10) || '        ' AS text FROM k GROUP BY conv_id", "turns")
def prj_formatted(spark, sf):
    found = _blanked(spark, sf).select("conversation_id", X.turns(F.col("messages")).alias("turns")).where(F.size("turns") > 0)
    return found.select("conversation_id", X.formatted(F.col("turns")).alias("text"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g')"


@query(f"WITH {_PLACED} SELECT conv_id AS conversation_id, string_agg(speaker || '|' || {_CLEAN.format('text')} || '|' || CASE role WHEN 'assistant' THEN 'true' WHEN 'user' THEN 'false' ELSE 'null' END, chr(10) ORDER BY turn) AS turns FROM k GROUP BY conv_id", "turns")
def prj_clean_turns(spark, sf):
    found = _blanked(spark, sf).select("conversation_id", X.turns(F.col("messages"), X.clean).alias("turns")).where(F.size("turns") > 0)
    return found.select("conversation_id", F.array_join(F.transform("turns", lambda t: F.concat_ws("|", t["speaker"], t["text"], F.coalesce(t["is_agent"].cast("string"), F.lit("null")))), "\n").alias("turns"))


@query("WITH l AS (SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'Agent: ' ELSE 'Klient: ' END || replace(text, ':', ';') || '  ', chr(10) ORDER BY turn) AS t, count(*) AS n, arg_min(role, turn) AS r, arg_max(text, turn) AS last FROM turns GROUP BY conv_id) SELECT conv_id, n, CASE r WHEN 'assistant' THEN 'Agent' ELSE 'Klient' END AS first_speaker, regexp_replace(replace(last, ':', ';'), '^\\s+|\\s+$', '', 'g') AS last_text FROM l".replace("\\\\", "\\"), "turns")
def prj_parse_labelled(spark, sf):
    line = F.concat(F.when(F.col("role") == "assistant", "Agent: ").otherwise("Klient: "), F.replace("text", F.lit(":"), F.lit(";")), F.lit("  "))
    t = view(spark, sf, "turns").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x.l), "\n").alias("t"))
    t = t.select("conv_id", X.parse_labelled(F.col("t"), X.SPEAKERS["et"]).alias("p"))
    return t.select("conv_id", F.size("p").cast("long").alias("n"), F.element_at("p", 1).speaker.alias("first_speaker"), F.element_at("p", -1).text.alias("last_text"))


def _fillers(language):
    return "(^|[^\\p{L}\\p{N}_])(?i:" + "|".join(X.PROFILES[language].fillers) + ")($|[^\\p{L}\\p{N}_])"


@query("""WITH w AS (SELECT doc_id, 'Aha ' || (CASE doc_id % 3 WHEN 0 THEN 'okei' WHEN 1 THEN 'OKÉ' ELSE 'joo' END) || ' [x]  tere, hmmm ' || lang || ' (y) ahaa mhm' AS t FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' OKÉ ' ELSE ' joo ' END || ' tere,  ' || lang || '   ' AS et,
CASE doc_id % 3 WHEN 1 THEN ' OKÉ ' ELSE '  ' END || ' tere,  ' || lang || '  ahaa ' AS fi,
CASE doc_id % 3 WHEN 0 THEN ' okei ' WHEN 1 THEN '  ' ELSE ' joo ' END || ' tere,  ' || lang || '  ahaa ' AS hu FROM w JOIN documents USING (doc_id)""")
def prj_clean_languages(spark, sf):
    k = F.col("doc_id") % 3
    t = F.concat(F.lit("Aha "), F.when(k == 0, "okei").when(k == 1, "OKÉ").otherwise("joo"), F.lit(" [x]  tere, hmmm "), "lang", F.lit(" (y) ahaa mhm"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", *(X.clean(t, p).alias(c) for c, p in X.PROFILES.items()))


@query(r"WITH t AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: regexp_full_match(x, '\p{L}+')), lambda x: lower(x)) AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS n, array_to_string(w[1:8], ' ') AS head FROM t")
def prj_alpha_tokens(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.alpha_tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(F.slice("w", 1, 8), " ").alias("head"))


@query(r"WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x NOT IN ('der', 'the', 'les', 'el', 'und')) AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS n, array_to_string(w[1:8], ' ') AS head FROM t")
def join_stopwords(spark, sf):
    """Stopwords: built-in ones and those of a file."""
    path = put(spark.createDataFrame([("Les",), ("  el ",), ("",), ("und",)], "value string"), f"{folder(spark)}/words.txt")
    words = io.read_stopwords(spark, ("the", "der"), path)
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.tokens(F.col("text"), words).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(F.slice("w", 1, 8), " ").alias("head"))


_ASKED = "WITH p AS (SELECT conv_id, turn, CASE WHEN (conv_id + pos) % 5 = 0 THEN NULL ELSE role END AS name, CASE WHEN (conv_id + pos) % 7 = 0 THEN NULL WHEN role = 'assistant' THEN 'agent' WHEN role = 'user' THEN 'customer' ELSE role END AS kind, CASE WHEN (conv_id + pos) % 11 = 0 THEN NULL ELSE text END AS said FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM turns))"


@query(f"{_ASKED} SELECT conv_id AS conversation_id, 'Rate: ' || string_agg(coalesce(name, 'Unknown') || ' (' || coalesce(kind, 'unknown') || '): ' || coalesce(said, ''), chr(10) ORDER BY turn) || ' end' AS prompt FROM p GROUP BY conv_id", "turns")
def prj_prompt(spark, sf):
    """Some messages lack their author's name, its kind or the text."""
    lacks = lambda i, every: (F.col("conversation_id") + i) % every == 0
    gaps = lambda m, i: m.withField("from_name", F.when(~lacks(i, 5), m["from_name"])).withField("from_type", F.when(~lacks(i, 7), m["from_type"])).withField("message", F.when(~lacks(i, 11), m["message"]))
    asked = conversations(spark, sf).select("conversation_id", F.transform("messages", gaps).alias("messages"))
    return asked.select("conversation_id", X.prompt("Rate: {conversation} end", F.col("messages")).alias("prompt"))


_NAMED = "CASE c_custkey % 4 WHEN 0 THEN concat('anthropic.Cl_', c_custkey) WHEN 1 THEN concat('us/meta.mistral.x.', c_custkey) WHEN 2 THEN concat('openai.gpt-', c_custkey, '.1') ELSE concat('cohere.cohere.C/', c_custkey) END"


@query(f"""WITH c AS (SELECT *, {_NAMED} AS model, CASE c_nationkey % 5 WHEN 0 THEN 'et' WHEN 1 THEN 'en' WHEN 2 THEN 'xx' WHEN 3 THEN NULL ELSE 'en-us' END AS code FROM customer)
SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN concat('org-m', c_custkey, '-high') WHEN 1 THEN concat('org-m', c_custkey) ELSE concat('m', c_custkey, '-low') END AS judge,
replace(replace(replace(replace(model, 'anthropic.', ''), 'cohere.', ''), 'meta.', ''), 'mistral.', '') AS shown,
'controlled-generated-convos-' || lower(replace(replace(model, '/', '-'), '_', '-')) AS dataset, lower(replace(replace(replace(model, '/', '-'), '_', '-'), '.', '-')) AS tag, replace(replace(replace(model, '.', '_'), '-', '_'), '/', '_') AS citation,
'Synthetic customer support conversations generated using ' || model || CASE WHEN c_nationkey % 2 = 0 THEN ' Available in languages: et, ' || c_mktsegment || '.' ELSE '' END AS description,
CASE WHEN c_nationkey % 4 = 1 THEN printf('%.2f', c_acctbal / 1000) ELSE printf('%.2f±%.2f', c_acctbal / 1000, c_custkey / 7.0) END AS spread,
CASE code WHEN 'et' THEN 'Estonian' WHEN 'en-us' THEN 'English' ELSE code END AS language,
'- Language: ' || CASE WHEN code = 'et' THEN 'Estonian (et)' WHEN code IS NULL OR code = 'en-us' THEN 'English (en-us)' ELSE code || ' (' || code || ')' END || chr(10) || '- Industry: ' || c_mktsegment || chr(10) || '- Customer problem: General inquiry' || chr(10) || '- Number of messages: 6' || chr(10) || '- Number of agents: ' || (c_custkey % 3) || ' agent(s)' || chr(10)
|| '- Agent names: A, ' || c_name || chr(10) || '- Channel: chat' || chr(10) || '- Agent experience level: senior' || chr(10) || '- Agent type: human' AS parts FROM c""")
def prj_display(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k, key = F.col("c_nationkey") % 3, F.col("c_custkey").cast("string")
    judge = X.judge_name(F.when(k < 2, F.concat(F.lit("org/m"), key)).otherwise(F.concat(F.lit("m"), key)), F.when(k == 0, "high").when(k == 1, "").otherwise("low"))
    at = F.col("c_custkey") % 4
    model = F.when(at == 0, F.concat(F.lit("anthropic.Cl_"), key)).when(at == 1, F.concat(F.lit("us/meta.mistral.x."), key)).when(at == 2, F.concat(F.lit("openai.gpt-"), key, F.lit(".1"))).otherwise(F.concat(F.lit("cohere.cohere.C/"), key))
    n = F.col("c_nationkey") % 5
    language = F.when(n == 0, "et").when(n == 1, "en").when(n == 2, "xx").when(n == 4, "en-us")
    languages = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("et"), "c_mktsegment")).otherwise(F.array().cast("array<string>"))
    spread = X.mean_std(F.col("c_acctbal") / 1000, F.when(F.col("c_nationkey") % 4 != 1, F.col("c_custkey") / 7.0))
    parts = X.config_prompt({"language": language, "industry": F.col("c_mktsegment"), "n_agents": F.col("c_custkey") % 3, "agent_names": F.array(F.lit("A"), "c_name")})
    return c.select("c_custkey", judge.alias("judge"), X.display_name(model).alias("shown"), X.dataset_name(model).alias("dataset"), X.model_tag(model).alias("tag"), X.citation_key(model).alias("citation"), X.dataset_description(model, languages).alias("description"), spread.alias("spread"), X.language_name(language).alias("language"), parts.alias("parts"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp, CAST(strftime(ts, '%Y%m%d-%H%M%S') = strftime(strptime(strftime(ts, '%Y%m%d-%H%M%S'), '%Y%m%d-%H%M%S'), '%Y%m%d-%H%M%S') AS BOOLEAN) AS same, CAST(date_diff('second', TIMESTAMP '2020-01-01', date_trunc('second', ts)) AS BIGINT) AS elapsed FROM events")
def fn_dates(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    stamp = X.stamp(F.col("ts"))
    return e.select("event_id", stamp.alias("stamp"), (X.stamp(X.stamp_time(stamp)) == stamp).alias("same"), X.seconds_between(F.lit("2020-01-01 00:00:00").cast("timestamp"), F.col("ts")).alias("elapsed"))


@query("SELECT event_id, event_type AS kind, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'none') AS looked, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS size, 'user ' || user_id AS name FROM events")
def fn_maps(spark, sf):
    """Lookup with a default, merge, nested get and update."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    own = X.merged(F.create_map(F.lit("id"), F.col("user_id").cast("string")), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("type"), "event_type")).otherwise(F.expr("map()").cast("map<string,string>")))
    s = F.struct(F.struct(F.col("event_type").alias("kind"), F.lit("?").alias("name")).alias("inner")).withField("inner.name", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    d = e.select("event_id", own.alias("m"), s.alias("s"))
    return d.select("event_id", F.col("s.inner.kind").alias("kind"), X.looked_up(F.col("m"), "type", "none").alias("looked"), F.size("m").alias("size"), F.col("s.inner.name").alias("name"))


@query("SELECT conv_id AS conversation_id, string_agg(role || '>' || text, chr(10) ORDER BY turn) AS turns FROM turns WHERE trim(text) <> '' GROUP BY conv_id", "turns")
def prj_turns_as_dicts(spark, sf):
    turns = X.turns(F.col("messages"))
    pairs = F.transform(turns, lambda t: F.struct(t["speaker"].alias("speaker"), t["text"].alias("text")))
    found = conversations(spark, sf).select("conversation_id", pairs.alias("p")).where(F.size("p") > 0)
    return found.select("conversation_id", F.array_join(F.transform("p", lambda t: F.concat(t["speaker"], F.lit(">"), t["text"])), "\n").alias("turns"))


@query("WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT a, b, round(s, 9) AS similarity FROM p")
def stat_cosine(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return longs(a.join(b, "a"), "a", "b").select("a", "b", F.round(M.cosine(F.col("x"), F.col("y")), 9).alias("similarity"))
