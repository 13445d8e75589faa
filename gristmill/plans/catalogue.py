"""The registered queries for the engine's own operators, over the driver tables that stand in for its own, and their SQL.

conversations stands for the turns, documents for the file corpus (doc_id: path, source: repository), pages for listing
pages and addresses, events of type error for the failure queue. Each runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import chat, html, questions, text, urls
from gristmill.operators import conversations as conv
from gristmill.operators import incremental as inc
from gristmill.operators import store
from gristmill.operators.ids import dense_ids
from gristmill.plans import pipeline
from gristmill.settings import DEFAULT_SYSTEM, TRUNCATE_MARK
from gristmill.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").cast("int").alias("turn_index"), "role", F.col("text").alias("content"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("sample_id")).agg((F.count("*") > 2).alias("is_multiturn"))
    return g.select("sample_id", text.source_tag(F.concat(F.lit("f"), F.col("sample_id") % 50)).alias("dataset_source"), "is_multiturn")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("source").alias("repo"), F.col("n_chars").alias("size"), F.col("text").alias("content"))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_path", text.sha256(F.col("content")).alias("content_hash"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier run: two thirds of the files, some with another hash, and some that are gone."""
    d = _t(spark, sf_dir, "documents")
    was = d.where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("file_path"), F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(text.sha256(F.col("text"))).alias("content_hash"))
    gone = d.where("doc_id % 7 = 0").select(F.concat(F.lit("gone/"), F.col("doc_id")).alias("file_path"), F.lit("old").alias("content_hash"))
    return was.union(gone)


_SAID = """select conv_id, coalesce(string_agg(text, chr(10) order by turn) filter (where role = 'user'), '') as u, coalesce(string_agg(text, chr(10) order by turn) filter (where role = 'assistant'), '') as a,
  coalesce(max_by(text, turn) filter (where role = 'system'), '') as s from conversations group by conv_id"""
_STORED = """(select doc_id::varchar as file_path, case when doc_id % 5 = 0 then 'stale' else sha256(text) end as content_hash from documents where doc_id % 3 <> 0
  union all select 'gone/' || doc_id, 'old' from documents where doc_id % 7 = 0)"""


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.collect_conversations(_turns(spark, sf_dir)).withColumnRenamed("sample_id", "conv_id")


@query(f"select conv_id, u as instruction, '' as input, a as output from ({_SAID})")
def export_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", chat.alpaca(F.col("system"), F.col("user"), F.col("assistant")).alias("r")).select("conv_id", "r.*")


def _line(template: str) -> Query:
    return lambda spark, sf_dir: conv.rendered(_conversations(spark, sf_dir), template, "conv_id")


def _named(name: str, f: Query) -> Query:
    f.__name__ = name
    return f


_csv = lambda c: f"""case when regexp_matches({c}, '[",\\r\\n]') then '"' || replace({c}, '"', '""') || '"' else {c} end"""
query(f"select conv_id, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || case when s = '' then '{DEFAULT_SYSTEM}' else s end || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || u || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || a || '<|eot_id|>' as line from ({_SAID})")(_named("export_llama3", _line("llama3")))
query(f"select conv_id, '<s>[INST] ' || case when s = '' then '' else s || chr(10) || chr(10) end || u || ' [/INST]' || a || '</s>' as line from ({_SAID})")(_named("export_mistral", _line("mistral")))
query(f"select conv_id, '<start_of_turn>user' || chr(10) || u || '<end_of_turn><start_of_turn>model' || chr(10) || a || '<end_of_turn>' as line from ({_SAID})")(_named("export_gemma", _line("gemma")))
query(f"select conv_id, {_csv('u')} || ',' || {_csv('a')} as line from ({_SAID})")(_named("export_csv", _line("csv")))
query(f"""select conv_id, '{{"messages":[' || case when s = '' then '' else '{{"role":"system","content":' || to_json(s) || '}},' end || '{{"role":"user","content":' || to_json(u) || '}},{{"role":"assistant","content":' || to_json(a) || '}}]}}' as line from ({_SAID})""")(_named("export_chatml", _line("chatml-jsonl")))
query(f"""select conv_id, '{{"instruction":' || to_json(u) || ',"input":"","output":' || to_json(a) || '}}' as line from ({_SAID})""")(_named("export_alpaca_jsonl", _line("alpaca-jsonl")))


@query(f"select conv_id, '<|im_start|><|im_start|>user' || chr(10) || u || '<|im_end|><|im_start|>assistant' || chr(10) || a || '<|im_end|>' as line from ({_SAID})")
def render_qwen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", chat.qwen(F.col("system"), F.col("user"), F.col("assistant")).alias("line"))


_SAMPLES = "(select conv_id as sample_id, 'repo_file:f' || (conv_id % 50) as dataset_source, count(*) > 2 as is_multiturn from conversations group by 1, 2)"


@query(f"select s.sample_id, dataset_source, is_multiturn, turn::int as turn_index, role, text as content from {_SAMPLES} s join conversations c on s.sample_id = c.conv_id")
def export_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.joined_turns(_samples(spark, sf_dir), _turns(spark, sf_dir))


@query("select doc_id, sha256(text) as content_hash from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.sha256(F.col("text")).alias("content_hash"))


_KEPT = "n_chars <= 5000 and not suffix(text, 'a.') and not suffix(text, 'e.') and not starts_with(regexp_replace(text, '(?s)^.*/', ''), '.')"


@query(f"select doc_id::varchar as file_path, source as repo, {_KEPT} as kept from documents")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stand for names: suffixes, size and a leading dot."""
    return _files(spark, sf_dir).select("file_path", "repo", files.wanted(F.col("content"), F.col("size"), 5000, ("a.", "e.")).alias("kept"))


@query(f"select source as repo, count(*) filter (where {_KEPT}) as kept, count(*) filter (where not ({_KEPT})) as skipped from documents group by 1")
def kept_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.kept_skipped(file_filter(spark, sf_dir))


@query(f"""select coalesce(c.file_path, s.file_path) as file_path, c.content_hash, case when c.content_hash is null then 'removed' when s.content_hash is null then 'new' when s.content_hash = c.content_hash then 'unchanged' else 'updated' end as status
from (select doc_id::varchar as file_path, sha256(text) as content_hash from documents) c full join {_STORED} s on c.file_path = s.file_path""")
def incremental_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.file_status(_hashed(spark, sf_dir), _stored(spark, sf_dir))


@query(f"select c.* from (select doc_id::varchar as file_path, sha256(text) as content_hash from documents) c left join {_STORED} s on c.file_path = s.file_path where s.content_hash is distinct from c.content_hash")
def files_to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.to_process(_hashed(spark, sf_dir), _stored(spark, sf_dir))


@query(f"select c.file_path, s.content_hash from (select doc_id::varchar as file_path from documents) c left join {_STORED} s on c.file_path = s.file_path")
def hash_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.looked_up(_files(spark, sf_dir), _stored(spark, sf_dir))


@query(f"select file_path from {_STORED} where file_path not in (select doc_id::varchar from documents)")
def removed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.removed_files(_stored(spark, sf_dir), _files(spark, sf_dir))


@query("select distinct 'f' || (u.conv_id % 50) as file_path, sha256(u.text) as q_hash from conversations u join conversations a on u.conv_id = a.conv_id and u.role = 'user' and a.role = 'assistant'")
def processed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.processed_hashes(_samples(spark, sf_dir), _turns(spark, sf_dir))


@query("""with p as (select distinct 'f' || (u.conv_id % 50) as file_path, sha256(u.text) as q_hash from conversations u join conversations a on u.conv_id = a.conv_id and u.role = 'user' and a.role = 'assistant' where u.conv_id % 2 = 0)
select c.file_path, c.question, c.q_hash from (select 'f' || (conv_id % 50) as file_path, text as question, sha256(text) as q_hash from conversations where role = 'user') c where not exists (select 1 from p where p.file_path = c.file_path and p.q_hash = c.q_hash)""")
def new_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answered half of the conversations is the history; all user turns are asked."""
    turns = _turns(spark, sf_dir)
    history = inc.processed_hashes(_samples(spark, sf_dir).where("sample_id % 2 = 0"), turns)
    return inc.new_questions(turns.where("role = 'user'").select(F.concat(F.lit("f"), F.col("sample_id") % 50).alias("file_path"), F.col("content").alias("question")), history)


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def hash_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.latest(_t(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "value")


@query(f"select file_path, content_hash from {_STORED} where file_path not in (select doc_id::varchar from documents where doc_id % 2 = 0) union all select doc_id::varchar, sha256(text) from documents where doc_id % 2 = 0")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.upsert(_stored(spark, sf_dir), _hashed(spark, sf_dir).where("cast(file_path as long) % 2 = 0"), ["file_path"])


@query("select doc_id from documents where not starts_with(lower('repo_file:' || source || '/' || doc_id), lower('repo_file:SRC1'))")
def prefix_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = text.source_tag(F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return _t(spark, sf_dir, "documents").where(~text.source_like(tag, F.lit("SRC1"))).select("doc_id")


@query(f"select sample_id, turn::int as turn_index from {_SAMPLES} s join conversations c on s.sample_id = c.conv_id where dataset_source not in ('repo_file:f1', 'repo_file:f2')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("f1",), ("f2",)], "file_path string")
    return store.without(_turns(spark, sf_dir), store.samples_of(_samples(spark, sf_dir), gone)).select("sample_id", "turn_index")


@query("select user_id, count(*) as failures, max(event_id) as last_event from events where event_type = 'error' and user_id not in (select user_id from events where event_type = 'purchase' and value > 90) group by user_id")
def failed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue without those that succeeded since, each once."""
    e = _t(spark, sf_dir, "events")
    done = e.where("event_type = 'purchase' and value > 90").select("user_id")
    return pipeline.without_done(e.where("event_type = 'error'"), done, "user_id").groupBy("user_id").agg(F.count("*").alias("failures"), F.max("event_id").alias("last_event"))


@query("""select doc_id, generate_subscripts(q, 1) - 1 as place, unnest(q) as question from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: suffix(x, '.')) as q from documents) where len(q) > 0""")
def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No document has a question mark: lines that end with a full stop."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(questions.question_lines(F.col("text"), ".")).alias("place", "question")).select("doc_id", F.col("place").cast("long").alias("place"), "question")


@query(f"select doc_id, case when length(text) > 2048 then substr(text, 1, 1024) || '{TRUNCATE_MARK.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}' || right(text, 1024) else text end as context from documents")
def truncate_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.truncate_context(F.col("text")).alias("context"))


_SEG = "list_filter(string_split(regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> '')"
_NET = "regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)"


@query(f"select page_id, case when not contains({_NET}, 'example') then 'direct' when len({_SEG}) = 1 then 'org_page' when len({_SEG}) >= 2 then 'direct_repo' else 'direct_unclear' end as kind from pages")
def url_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", urls.url_kind(F.col("url"), "example").alias("kind"))


@query(f"select page_id, case when contains({_NET}, 'example') and len({_SEG}) >= 2 then 'repos/' || ({_SEG})[1] || '/' || replace(({_SEG})[2], '.git', '') else 'repos/' || replace(string_split(url, '/')[-1], '.git', '') end as path from pages")
def clone_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", urls.clone_path(F.col("url"), host="example").alias("path"))


@query("""select distinct page_id, 'https://github.com' || unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) as url from pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages").select("page_id", F.explode(html.relative_hrefs(F.col("html"))).alias("href"))
    return p.select("page_id", urls.absolute_link(F.col("href")).alias("url"))


@query()
def html_repo_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four ways of finding repositories, by parsing (not SQL); tested on fixtures."""
    return _t(spark, sf_dir, "pages").select("page_id", F.explode_outer(html.repo_links_udf(F.col("html"))).alias("url"))


@query("select url from (select url from pages union select 'https://github.com' || unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) from pages)")
def union_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("url").union(html_links(spark, sf_dir).select("url")).distinct()


@query("select conv_id, row_number() over (order by conv_id) as sample_id from (select distinct conv_id from conversations)")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_ids(_t(spark, sf_dir, "conversations").select("conv_id").distinct(), ["conv_id"], "sample_id")


@query("select doc_id from documents where doc_id >= 100")
def resume_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.resume(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("select doc_id, cast(floor((row_number() over (order by doc_id) - 1) / 10) as bigint) as batch from documents")
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dense_ids(_t(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "n", start=0)
    return d.select("doc_id", F.floor(F.col("n") / 10).cast("long").alias("batch"))


@query("select 'f' || (conv_id % 50) as file_path, count(*) as qa_count from conversations where role = 'user' group by 1")
def qa_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.qa_counts(_turns(spark, sf_dir).where("role = 'user'").select(F.concat(F.lit("f"), F.col("sample_id") % 50).alias("file_path")))


@query("select conv_id, nullif(trim(replace(replace('Answer: ' || a.text || ' ' || q.text, 'Answer:', ''), q.text, '')), '') as answer, a.turn::bigint as turn from conversations a join conversations q using (conv_id) where a.role = 'assistant' and q.role = 'user' and q.turn = a.turn - 1")
def answer_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    return c.where("role = 'assistant'").join(q, ["conv_id", "turn"]).select("conv_id", questions.clean_answer(F.concat(F.lit("Answer: "), F.col("text"), F.lit(" "), F.col("q")), F.col("q")).alias("answer"), "turn")


@query("select conv_id, nullif(trim(string_agg(text, '' order by turn)), '') as reply from conversations group by conv_id")
def sse_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as the deltas of one streamed reply, folded back."""
    delta = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    g = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", delta.alias("d")))).alias("d"))
    stream = F.concat(F.transform("d", lambda x: x["d"]), F.array(F.lit(": comment"), F.lit("data: [DONE]")))
    return g.select("conv_id", chat.sse_text(stream).alias("reply"))


@query()
def parse_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text to questions (an Arrow UDF); full stops stand for question marks. Tested on fixtures."""
    return _t(spark, sf_dir, "documents").select("doc_id", questions.parsed_or_whole(F.translate("text", ".", "?")).alias("questions"))


@query("select sha256(t) as q, md5(t || '_0.7_500') as memo from (select distinct text as t from conversations where role = 'user')")
def memo_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts are made distinct before any call, and named for the memo."""
    c = _t(spark, sf_dir, "conversations").where("role = 'user'").select("text").distinct()
    return c.select(text.sha256(F.col("text")).alias("q"), text.memo_key(F.col("text"), F.lit(0.7), F.lit(500)).alias("memo"))


@query("select source as repo, sum(n_chars)::bigint as bytes, count(*) as files from documents group by 1")
def repo_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sizes(_files(spark, sf_dir), "repo")


@query("select page_id, url, string_split(url, '/')[-1] as base, regexp_replace(url, '/[^/]*$', '') as folder from pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", "url", text.base_name(F.col("url")).alias("base"), text.dir_name(F.col("url")).alias("folder"))


@query("select doc_id, n_chars * 1000 as n, replace(replace('models--' || lang || '--' || source, 'models--', ''), '--', '/') as model, cast(ceil(n_chars / 10) as bigint) as batches from documents")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", (F.col("n_chars") * 1000).alias("n"), text.cache_dir_model(F.concat(F.lit("models--"), "lang", F.lit("--"), "source")).alias("model"), text.batch_count(F.col("n_chars"), 10).alias("batches"))


@query("select event_id, event_type from (select event_id, event_type, ts, row_number() over (order by ts desc, event_id desc) as n from events) where n <= 5")
def newest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention: the five newest (a top-k is the feature)."""
    return inc.newest(_t(spark, sf_dir, "events"), [F.col("ts").desc(), F.col("event_id").desc()], 5).select("event_id", "event_type")


@query("""select source as repo, count(distinct text) as distinct_texts, count(*) as n from documents group by 1""")
def distinct_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.distinct_contents(_files(spark, sf_dir))


@query("select conv_id, turn, lag(role) over (partition by conv_id order by turn) as before from conversations")
def turn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.with_previous(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "before")
