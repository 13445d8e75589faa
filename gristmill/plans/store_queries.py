"""Registered queries that go through the store and the plans that write to it, over the driver tables that stand in.

Each makes a store in the shared folder, writes as a run would, and returns what the store then has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators.ids import settle, shared_dir
from gristmill.operators.store import TableStore
from gristmill.plans import pipeline
from gristmill.plans.catalogue import _SAID, _STORED, _conversations, _files, _stored, _t, query
from gristmill.plans.generate import StubGenerator
from gristmill.settings import NO_QUESTIONS, Settings


def _store(spark: SparkSession) -> TableStore:
    return TableStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query(f"""with u as (select doc_id::varchar as file_path, sha256(text) as content_hash from documents where doc_id % 2 = 0)
select file_path, content_hash from (select * from {_STORED} where file_path not in (select file_path from u) union all select * from u) where file_path not in (select doc_id::varchar from documents where doc_id % 11 = 0)""")
def store_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes stored, replaced and deleted."""
    store, d = _store(spark), _t(spark, sf_dir, "documents")
    store.save_hashes(_stored(spark, sf_dir))
    store.save_hashes(d.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("file_path"), text.sha256(F.col("text")).alias("content_hash")))
    store.remove("file_hashes", d.where("doc_id % 11 = 0").select(F.col("doc_id").cast("string").alias("file_path")))
    return store.read("file_hashes").select("file_path", "content_hash")


_PAIRS = f"(select 'f' || (conv_id % 50) as file_path, conv_id as place, u as q, a from ({_SAID}))"


@query(f"""with p as (select * from {_PAIRS}), one as (select row_number() over (order by file_path, place) as sample_id, * from p where place % 2 = 0),
two as (select (select count(*) from one) + row_number() over (order by file_path, place) as sample_id, * from p where place % 2 = 1),
s as (select * from one where file_path not in (select 'f' || (conv_id % 50) from conversations where conv_id % 50 % 7 = 0) union all select * from two)
select sample_id, 'repo_file:' || file_path as dataset_source, 0 as turn_index, 'user' as role, q as content, false as is_label from s
union all select sample_id, 'repo_file:' || file_path, 1, 'assistant', a, true from s""")
def store_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs appended, those of some files deleted with their turns, and more appended, whose ids go on above all before."""
    store = _store(spark)
    pairs = _conversations(spark, sf_dir).select(F.concat(F.lit("f"), F.col("conv_id") % 50).alias("file_path"), F.col("conv_id").alias("place"), F.col("user").alias("question"), F.col("assistant").alias("answer"))
    store.add_pairs(pairs.where("place % 2 = 0"))
    store.delete_samples(pairs.where("place % 50 % 7 = 0"))
    store.add_pairs(pairs.where("place % 2 = 1"))
    return pipeline.joined_turns(store.read("training_samples"), store.read("conversation_turns")).select("sample_id", "dataset_source", "turn_index", "role", "content", "is_label")


@query("""with e as (select user_id::varchar as file_path, props as reason, event_id, row_number() over (order by user_id::varchar, props, event_id) as n from events where event_type = 'error')
select file_path, reason, count(*) as n from e where file_path not in (select user_id::varchar from events where event_type = 'purchase' and value > 90) group by file_path, reason""")
def store_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures appended, several for a file, and those of files that succeeded since taken out."""
    store, e = _store(spark), _t(spark, sf_dir, "events").withColumn("file_path", F.col("user_id").cast("string"))
    store.add_failures(e.where("event_type = 'error'").select("file_path", F.col("props").alias("reason")))
    store.remove("failed_files", e.where("event_type = 'purchase' and value > 90"))
    return store.read("failed_files").groupBy("file_path", "reason").agg(F.count("*").alias("n"))


_WORD = "[\\p{L}\\p{N}_]+"


@query(f"""with f as (select doc_id, text, regexp_extract_all(text, '{_WORD}') as w from documents where doc_id::varchar not in (select file_path from {_STORED} s join documents d on file_path = d.doc_id::varchar where content_hash = sha256(d.text))),
x as (select doc_id, text, unnest(w) as w, generate_subscripts(w, 1) as i from f), g as (select doc_id, text, w, min(i) as i from x group by doc_id, text, w),
r as (select *, row_number() over (partition by doc_id order by i) as n from g)
select doc_id::varchar as file_path, 'What does ' || w || ' mean here?' as question, 'It is one of ' || len(regexp_extract_all(text, '[^\\s\\x0B]+')) || ' words.' as answer from r where n <= 2 and not contains(text, 'AKIA')""")
def prepare_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and changed files through the whole plan, with the stub as the model: what is asked, answered and stored. Files with a
    certain mark get no questions."""
    store = _store(spark)
    store.save_hashes(_stored(spark, sf_dir))
    files = _files(spark, sf_dir).withColumn("content_hash", text.sha256(F.col("content"))).withColumn("error", F.lit(None).cast("string"))
    pipeline.process(pipeline.to_process(files, store.read("file_hashes")), store, StubGenerator(fail="AKIA"), Settings())
    turns = pipeline.joined_turns(store.read("training_samples"), store.read("conversation_turns"))
    said = turns.groupBy("sample_id", text.source_path(F.col("dataset_source")).alias("file_path")).agg(F.max_by("content", F.col("role") == "user").alias("question"), F.max_by("content", F.col("role") == "assistant").alias("answer"))
    return said.drop("sample_id")


@query(f"""with f as (select doc_id::varchar as file_path, text, sha256(text) as h from documents), t as (select f.* from f left join {_STORED} s using (file_path) where s.content_hash is distinct from h)
select file_path, contains(text, 'AKIA') as failed, case when contains(text, 'AKIA') then '{NO_QUESTIONS}' end as reason, case when not contains(text, 'AKIA') then h end as stored_hash from t""")
def prepare_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run says of each file it worked on, with the failure or the hash that it stored; a file that fails may have an old hash, which stays and isn't shown."""
    store = _store(spark)
    store.save_hashes(_stored(spark, sf_dir))
    files = _files(spark, sf_dir).withColumn("content_hash", text.sha256(F.col("content"))).withColumn("error", F.lit(None).cast("string"))
    done = settle(pipeline.process(pipeline.to_process(files, store.read("file_hashes")), store, StubGenerator(fail="AKIA"), Settings()))
    x = done.join(store.read("failed_files").select("file_path", "reason"), "file_path", "left").join(store.read("file_hashes").select("file_path", "content_hash"), "file_path", "left")
    return x.select("file_path", (~F.col("success")).alias("failed"), "reason", F.when(F.col("success") & (F.col("qa_count") > 0), F.col("content_hash")).alias("stored_hash"))
