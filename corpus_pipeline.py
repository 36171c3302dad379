"""The corpus pipeline: language ID, near-dedup, decontamination, personal data, mixing."""

from foldspark.llm import decontaminate, langid, minhash, mix, pii
from foldspark.llm.common import cut, drop, short_batches
from foldspark.sources.tables import table


def language(spark, docs, sf_dir):
    """Keeps documents with a predicted language; null texts and texts without a letter have none."""
    short_batches(spark)
    return langid.kept(docs)


def near_dedup(spark, docs, sf_dir):
    """Keeps one document of each near-duplicate group, linked from a similarity of 0.8 on five-word
    shingles: the first row of the group's least doc_id. Rows of equal id and unlike texts all stay."""
    short_batches(spark)
    return minhash.one_of_each(docs, percent=80)


def decontamination(spark, docs, sf_dir):
    """Drops documents that hold a benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Keeps every document, with personal data masked."""
    short_batches(spark)
    return pii.mask(docs)


def mixing(spark, docs, sf_dir):
    """The documents taken into the mix, with the words taken and their source's target."""
    taken = mix.mix(docs, mix.label_weights(table(spark, sf_dir, "labels"))).where("taken > 0")
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("language ID", language), ("near-dedup", near_dedup), ("decontamination", decontamination), ("personal data", personal_data), ("mixing", mixing)]
#: Language ID has no SQL form, so the pipeline has none.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Each stage is written as Parquet in the shared folder and reread; what the next stage has read goes."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        if last is not None:
            drop(last)
        last = docs
    return docs
