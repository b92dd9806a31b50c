"""Inputs of the registered queries, as Spark tables and as DuckDB views of the same content.

Vectors whose id is divisible by 50 are the queries and all vectors the
passages, but for a query itself; equal labels are relevant.  The codebook stands in for a pretrained one: code c
is chunk c % 8 of vector c.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS, CODES, OUTPUTS = 8, 32, 128


class Tables:
    """The tables of one folder, read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")

    @property
    def queries(self) -> DataFrame:
        return self.vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding", "label")

    @property
    def passages(self) -> DataFrame:
        return self.vectors.select(F.col("id").alias("pid"), "embedding", "label")

    @property
    def qrels(self) -> DataFrame:
        return self.queries.select("qid", "label").join(self.passages.select("pid", "label"), "label").where("qid <> pid").select("qid", "pid")

    @property
    def chunks(self) -> DataFrame:
        from codevane.operators.quantize import chunk

        return chunk(self.vectors, CHUNKS)

    @property
    def codebook(self) -> DataFrame:
        found = self.chunks.where((F.col("id") < CODES) & (F.col("chunk_no") == F.col("id") % CHUNKS))
        return found.select(F.col("id").cast("int").alias("code"), "v", F.lit(1.0).alias("cluster_size"), F.col("v").alias("embed_avg"))

    @property
    def weights(self) -> DataFrame:
        """(d, code, w) of a projection whose entries follow a formula."""
        d, j = self.spark.range(64).select(F.col("id").cast("int").alias("d")), self.spark.range(OUTPUTS).select(F.col("id").cast("int").alias("code"))
        return d.crossJoin(j).select("d", "code", (((31 * F.col("d") + 17 * F.col("code")) % 13 - 6) / 10.0).alias("w"))

    @property
    def text_qrels(self) -> DataFrame:
        """Documents that hold a benchmark text; the benchmark is a small fixed table."""
        docs, items = self.read("documents").select("doc_id", "text"), self.read("benchmark").select("item_id", F.col("text").alias("q"))
        return docs.join(items, F.contains("text", "q")).select("item_id", "doc_id")


#: Named parts of the SQL; a part may use those above it.
PARTS = {
    "x": "select vec_id as id, label, cast(unnest(embedding) as double) as x, unnest(range(0, 64)) as d from embeddings",
    "cd": "select id, d // 8 as chunk_no, d % 8 as i, x from x",
    "cb": "select id as code, i, x as y from cd where id < 32 and chunk_no = id % 8",
    "dist": "select id, chunk_no, code, sum((x - y) * (x - y)) as dist from cd join cb using (i) group by all",
    "codes": "select id, chunk_no, arg_min(code, (dist, code)) as code from dist group by all",
    "tf": "select id, code, cast(count(*) as double) as weight from codes group by all",
    "q_tf": "select id as qid, code, weight from tf where id % 50 = 0",
    "p_tf": "select id as pid, code, weight from tf",
    "q_ids": "select vec_id as qid, label from embeddings where vec_id % 50 = 0",
    "p_ids": "select vec_id as pid, label from embeddings",
    "qrels": "select qid, pid from q_ids join p_ids using (label) where qid <> pid",
    "vq": "select qid, pid, sum(q.weight * p.weight) as score from q_tf q join p_tf p using (code) where qid <> pid group by all",
    "vq_run": "select qid, pid, score, row_number() over (partition by qid order by score desc, pid) as rank from vq qualify rank <= 1000",
    "dense": "select q.id as qid, p.id as pid, sum(q.x * p.x) as score from x q join x p using (d) where q.id % 50 = 0 and p.id <> q.id group by all",
    "dense_run": "select qid, pid, score, row_number() over (partition by qid order by score desc, pid) as rank from dense qualify rank <= 1000",
    "w": "select d, code, ((31 * d + 17 * code) % 13 - 6) / 10.0::double as w from (select unnest(range(0, 64)) as d) cross join (select unnest(range(0, 128)) as code)",
    "proj": "select id, code, least(ln(1 + greatest(sum(x * w), 0)), 10) as weight from x join w using (d) group by all",
    "proj9": "select id, code, round(weight, 9) as weight from proj",
    "rep": "select *, row_number() over (partition by id order by round(weight, 9) desc, code) as r from proj",
    "q_rep": "select id as qid, code, weight from rep where id % 50 = 0 and r <= 16 and weight > 1e-5",
    "p_rep": "select id as pid, code, weight from rep where r <= 64 and weight > 1e-5",
    "drawn": "select qid, pid, if(pos, qid, -(2 * qid + n)) as j from (select *, row_number() over (partition by qid, pos order by h, pid) as n from (select q.vec_id as qid, p.vec_id as pid, q.label = p.label as pos, md5('42|' || q.vec_id || '|' || p.vec_id) as h from embeddings q join embeddings p on q.vec_id % 50 = 0 and p.vec_id <> q.vec_id)) where n <= if(pos, 1, 2)",
    "terms": "select doc_id as pid, term, cast(count(*) as double) as weight from (select doc_id, unnest(string_split(text, ' ')) as term from documents) where term <> '' group by all",
    "q_terms": "select item_id as qid, term, cast(count(*) as double) as weight from (select item_id, unnest(string_split(text, ' ')) as term from benchmark) where term <> '' group by all",
    "text_qrels": "select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)",
}

#: The parts each part uses.
USES = {
    "cd": ["x"], "cb": ["cd"], "dist": ["cd", "cb"], "codes": ["dist"], "tf": ["codes"], "q_tf": ["tf"], "p_tf": ["tf"],
    "qrels": ["q_ids", "p_ids"], "vq": ["q_tf", "p_tf"], "vq_run": ["vq"], "dense": ["x"], "dense_run": ["dense"],
    "proj": ["x", "w"], "proj9": ["proj"], "rep": ["proj"], "q_rep": ["rep"], "p_rep": ["rep"],
}


def sql(body: str, *parts: str) -> str:
    """body after the definitions of the parts it names."""
    needed: set[str] = set()

    def need(name: str) -> None:
        for p in USES.get(name, []):
            need(p)
        needed.add(name)

    for p in parts:
        need(p)
    return "with " + ",\n".join(f"{n} as ({PARTS[n]})" for n in PARTS if n in needed) + "\n" + body if needed else body
