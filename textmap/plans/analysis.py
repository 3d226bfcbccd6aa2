"""The whole analysis: articles to TF-IDF, topics, map, regions and summary tables."""

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmap.operators import reduce as rd
from textmap.operators import regions, som, tfidf, vocabulary
from textmap.operators import summaries as sm
from textmap.params import AnalysisParams
from textmap.session import stage
from textmap.sources import corpus as co
from textmap.sources import sinks


@dataclass(frozen=True)
class Analysis:
    """Every fitted step and the tables it gave. All tables are keyed by doc_id, term_id, node."""

    params: AnalysisParams
    corpus: DataFrame
    vocabulary: vocabulary.Vocabulary
    rows: DataFrame
    reduction: rd.Reduction
    model: som.SomModel
    codebook: DataFrame
    assigned: DataFrame
    node_clusters: DataFrame
    measures: dict

    def map_table(self, n_topics: int = 4, n_features: int = 5) -> DataFrame:
        return sm.map_table(
            self.codebook, self.assigned, self.node_clusters, self.reduction.components, self.vocabulary.terms,
            self.params.som.kshape, n_topics, n_features,
        )

    def corpus_table(self, n_topics: int = 3, n_features: int = 5) -> DataFrame:
        return sm.corpus_table(
            self.corpus, self.assigned, self.node_clusters, self.codebook, self.reduction.components,
            self.vocabulary.terms, self.params.som.kshape, n_topics, n_features,
        )

    def session(self, run_id: str, timestamp: datetime) -> sinks.SessionTables:
        return sinks.session_tables(
            run_id, timestamp, self.codebook, self.assigned, self.reduction.components, self.vocabulary.terms,
            self.params.som.kshape, self.params.ward.n_clusters, self.reduction.n_topics,
        )

    def attributes(self, run_id: str) -> DataFrame:
        """Attributes of every step, with the errors of the map as the run itself measured them."""
        params = self.params
        steps = {
            "tfidf": {"corpus_size": self.vocabulary.n_docs, "n_features": self.vocabulary.n_terms},
            params.reducer: {"n_topics": self.reduction.n_topics, **self.reduction.attributes},
            "som": {
                "kshape": params.som.kshape, "n_nodes": params.som.n_nodes, "topology": params.som.topology,
                "learning_rate": params.som.learning_rate, "n_iter": self.model.n_iter, "converged": self.model.converged,
                **self.measures,
            },
            "ward": {"n_clusters": params.ward.n_clusters},
        }
        return sinks.attribute_rows(self.corpus.sparkSession, run_id, steps)


def reduce_rows(
    rows: DataFrame, tokenized: DataFrame, vocab: vocabulary.Vocabulary, params: AnalysisParams
) -> rd.Reduction:
    if params.reducer == "lsa":
        return rd.lsa(rows, vocab.n_docs, vocab.n_terms, params.lsa)
    if params.reducer == "nmf":
        return rd.nmf(rows, vocab.n_docs, vocab.n_terms, params.nmf)
    if params.reducer == "lda":
        return rd.lda(tokenized, vocab, params.lda)
    raise ValueError(f"unknown reducer: {params.reducer}")


def run_analysis(
    articles: DataFrame,
    params: AnalysisParams = AnalysisParams(),
    tokenizer: Callable[[Column], Column] | None = None,
    reducer: Callable[[DataFrame, DataFrame, vocabulary.Vocabulary], rd.Reduction] | None = None,
    k_init: som.Codebook | DataFrame | Callable[[DataFrame], DataFrame] | None = None,
) -> Analysis:
    """Run every step on (doc_id, title, body) rows.

    ``tokenizer`` maps the body column to an array of terms; ``reducer`` replaces the topic model.
    The sparse rows and the document vectors are stored once, since later steps scan them repeatedly.
    """
    corpus = stage(co.drop_incomplete(co.drop_duplicates(articles.select("doc_id", "title", "body"))), "corpus")
    if tokenizer is None:
        tokenized = vocabulary.tokenize(corpus, params.text)
    else:
        tokenized = corpus.select("doc_id", tokenizer(F.col("body")).alias("terms"))
    vocab = vocabulary.fit_vocabulary(tokenized, params.text, n_docs=corpus.count())
    rows = stage(tfidf.tfidf(tokenized, vocab, params.text.norm), "tfidf")
    found = reducer(rows, tokenized, vocab) if reducer is not None else reduce_rows(rows, tokenized, vocab, params)
    found = rd.Reduction(stage(found.vectors, "vectors"), found.components, found.n_topics, found.attributes)
    model = som.fit(found.vectors, params.som, width=found.n_topics, k_init=k_init)
    codebook = model.codebook.to_df(corpus.sparkSession)
    assigned, measures = som.place(found.vectors, model.codebook)
    clusters = regions.ward_regions(codebook, params.som.kshape, params.ward.n_clusters)
    return Analysis(params, corpus, vocab, rows, found, model, codebook, assigned, stage(clusters, "clusters"), measures)
