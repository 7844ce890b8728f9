"""Registered queries over word search, vectors, classifiers and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words
from ..operators import factors, learning, search
from ..sources.shared import Files
from .base import _K, folder, query
from .messy import messy_orders, table


@query(f"SELECT {_K} AS k, {_K} % 10 IN (1, 5) AS contained, {_K} % 10 IN (1, 3, 4, 5) AS any_case, {_K} % 10 IN (1, 3, 4) AS whole_word FROM orders")
def keyword_search(spark, sf_dir):
    note = F.col("note")
    return messy_orders(spark, sf_dir).select("k", note.contains("good").alias("contained"), F.lower(note).contains("good").alias("any_case"), note.rlike(r"(?i)\bgood\b").alias("whole_word"))


@query(f"SELECT {_K} AS k, {_K} % 13 IN (0, 5, 6, 8, 10, 12) AS found FROM orders")
def best_rules(spark, sf_dir):
    """Notes that take every branch: words, lemmas, phrases, negation near and far, by n't and by phrases, exclusions."""
    rules = search.best_rules(F.col("conduct"), {"better": "well", "goods": "good"})
    return messy_orders(spark, sf_dir).select("k", rules.alias("found"))


_SAID = (
    "he/he was/be very/very helpful/helpful and/and polite/polite", "not/not a/a good/good day/day", "she/she is/be n't/not good/good with/with tools/tool", "anything/anything but/but respectful/respectful",
    "lost/lose good/good time/time credits/credit", "never/never had/have good/good conduct/conduct time/time ,/, polite/polite man/man", "good/good times/time here/here", "goods/good delivered/deliver late/late",
    "no/no issues/issue on/on the/the wing/wing", "never/never had/have no/no issues/issue before/before", "a/a better/good worker/worker", "refused/refuse twice/twice",
    "not/not once/once in/in all/all these/these weeks/week was/be he/he good/good",
)

_QUOTED = ", ".join("'" + said.replace("'", "''") + "'" for said in _SAID)


@query(f"SELECT {_K} AS k, list_extract([{_QUOTED}], CAST({_K} % 13 AS INT) + 1) AS said FROM orders")
def lemma_tokens(spark, sf_dir):
    """Words and lemmas of each note, signs and both halves of contracted words included."""
    pairs = F.transform(words.lemmas(F.col("conduct")), lambda t: F.concat_ws("/", t["word"], t["lemma"]))
    return messy_orders(spark, sf_dir).select("k", F.array_join(pairs, " ").alias("said"))


@query(f"SELECT {_K} AS k, {_K} % 10 IN (2, 7) AS plain, {_K} % 10 = 7 AS kept FROM orders")
def phrase_search(spark, sf_dir):
    note, phrases = F.col("note"), ["very helpful", "refused to work"]
    return messy_orders(spark, sf_dir).select("k", search.lexicon(note, [], phrases=phrases).alias("plain"), search.lexicon(note, [], ["not"], 3, phrases=phrases).alias("kept"))


@query(f"""SELECT k, mistake FROM (SELECT {_K} AS k, CASE WHEN {_K} % 10 IN (2, 8) THEN 'false positive' WHEN {_K} % 10 = 4 THEN 'false negative' END AS mistake FROM orders)
 WHERE mistake IS NOT NULL ORDER BY mistake, k LIMIT 40""")
def mistakes(spark, sf_dir):
    found = search.lexicon(F.col("note"), ["helpful", "cooperative"])
    truth = F.expr("k % 10 IN (0, 4, 9)")
    kind = F.when(found & ~truth, "false positive").when(~found & truth, "false negative")
    return messy_orders(spark, sf_dir).select("k", kind.alias("mistake")).where("mistake IS NOT NULL").orderBy("mistake", "k").limit(40)


@query("""WITH p AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS pos FROM embeddings WHERE label IS NOT NULL),
 m AS (SELECT label, pos, avg(v) AS v FROM p GROUP BY label, pos), u AS (SELECT m.label, pos, v / n AS v FROM m JOIN (SELECT label, sqrt(sum(v * v)) AS n FROM m GROUP BY label) s ON m.label = s.label)
 SELECT x.label AS a, y.label AS b, round(sum(x.v * y.v), 6) AS similarity FROM u x JOIN u y ON x.pos = y.pos WHERE x.label <= y.label GROUP BY x.label, y.label""")
def class_cosines(spark, sf_dir):
    return learning.class_cosines(table(spark, sf_dir, "embeddings"), "label", "embedding")


_DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_COS = f"{_DOT.format('e.embedding', 'x.embedding')} / sqrt({_DOT.format('e.embedding', 'e.embedding')} * {_DOT.format('x.embedding', 'x.embedding')})"


@query(f"""WITH x AS (SELECT label < 5 AS yes, embedding FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings WHERE label IS NOT NULL GROUP BY label)),
 s AS (SELECT e.vec_id, e.label, max({_COS}) FILTER (WHERE yes) AS a, max({_COS}) FILTER (WHERE NOT yes) AS b FROM embeddings e, x GROUP BY e.vec_id, e.label)
 SELECT vec_id, label < 5 AS truth, a > b AS positive FROM s""")
def zero_shot(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    shown = e.where("label IS NOT NULL").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select("embedding", F.expr("label < 5").alias("positive"))
    return learning.zero_shot(e, shown, "embedding").select("vec_id", F.expr("label < 5").alias("truth"), "positive")


@query()
def few_shot(spark, sf_dir):
    """Vectors outside the 300 labelled ones; the truth is one label."""
    e = table(spark, sf_dir, "embeddings").withColumn("truth", F.col("label") == 0).where("truth IS NOT NULL")
    train = learning.sample(e, "vec_id", 300)
    rest = e.join(train.select("vec_id"), "vec_id", "left_anti")
    return learning.few_shot(rest, train, "embedding", "truth").select("vec_id", "truth", "predicted")


@query(f"SELECT doc_id, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR) || '-7'), 1, 8) < '{round(0.8 * 16**8) - 1:08x}' THEN 'train' ELSE 'test' END AS part FROM documents")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(learning.in_share("doc_id", 0.8), "train").otherwise("test").alias("part"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '-7'), doc_id) <= 100 THEN 'train' ELSE 'test' END AS part FROM documents")
def hash_cut(spark, sf_dir):
    return learning.split_at(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100).select("doc_id", "part")


@query("SELECT d.doc_id, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL ORDER BY md5(CAST(d.doc_id AS VARCHAR) || '-7'), d.doc_id LIMIT 60")
def labelled_sample(spark, sf_dir):
    """Documents with an answer, a fixed number by hash."""
    known = table(spark, sf_dir, "labels").select("doc_id", "quality").where("quality IS NOT NULL")
    return learning.sample(table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id"), "doc_id", 60)


_MADE: dict[tuple, str] = {}


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _made(spark, sf_dir, what, make):
    """Tables that several queries read, made once for a session and a state of the documents: folder of name -> table."""
    key = (spark.sparkContext.applicationId, sf_dir, what, Files(spark, f"{sf_dir}/documents.parquet").state())
    if key not in _MADE:
        out = folder(spark)
        for name, df in make().items():
            df.write.parquet(f"{out}/{name}")
        _MADE[key] = out
    return _MADE[key]


def _topics(spark, sf_dir, name):
    def make():
        found = factors.Topics(_documents(spark, sf_dir), "text", 5)
        return {"assigned": found.assigned().drop("text"), "words": found.words(10)}

    return spark.read.parquet(f"{_made(spark, sf_dir, 'topics', make)}/{name}")


@query()
def lsa_vectors(spark, sf_dir):
    return factors.LatentSemantics(_documents(spark, sf_dir), "text", 20).fitted().select("doc_id", "vector")


@query()
def topics(spark, sf_dir):
    return _topics(spark, sf_dir, "assigned").groupBy("topic").agg(F.count("*").alias("texts"))


@query()
def topic_words(spark, sf_dir):
    return _topics(spark, sf_dir, "words").select("topic", "place", "word")


@query()
def topic_examples(spark, sf_dir):
    return learning.examples(_topics(spark, sf_dir, "assigned"), "topic", "weight", "doc_id").select("topic", "place", "doc_id")


@query(f"""WITH x AS (SELECT label, embedding FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings WHERE label IS NOT NULL GROUP BY label))
 SELECT e.label AS a, x.label AS b, round({_COS}, 6) AS similarity FROM x e JOIN x ON e.label <= x.label""")
def pairwise_cosines(spark, sf_dir):
    """All pairs of a bounded set: the first vector of each label."""
    e = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    return learning.pairwise_cosines(e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")), "label", "embedding")


@query("""WITH w AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS name FROM documents),
 c AS (SELECT r, doc_id, name, count(*) AS n FROM w GROUP BY ALL), d AS (SELECT name, count(*) AS texts FROM c GROUP BY name HAVING count(*) >= 2),
 x AS (SELECT r, doc_id, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM documents)) / (1.0 + texts)) + 1) AS w FROM c JOIN d USING (name))
 SELECT doc_id, count(*) AS terms, round(sum(w) / sqrt(sum(w * w)), 4) AS total FROM x GROUP BY r, doc_id""")
def term_weights(spark, sf_dir):
    """Weights of words in two texts at least: how many each text has, and their sum, which shows each one's weight."""
    w = factors.Weights(_documents(spark, sf_dir), "text", least=2, log_counts=True)
    each = w.matrix.entries.groupBy("row").agg(F.count("*").alias("terms"), F.round(F.sum("w"), 4).alias("total"))
    return each.join(w.texts, F.col("row") == F.col("_key")).select("doc_id", "terms", "total")
