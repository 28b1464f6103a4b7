"""Word n-grams: counts, vocabulary, label bias and TF-IDF weights."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IDF, Normalizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.text import strings, words
from wardlight.session import stored

LEAK_VOCABULARY, LEAK_NGRAMS = 5000, 3
BASELINE_VOCABULARY, BASELINE_NGRAMS = 1000, 2
CODES_A_GRAM = 4  # so many times the grams that are asked for are looked at as codes, to see where ties at the border end
StopWords = list[str] | str | None


def with_ngrams(df: DataFrame, longest: int, stop_words: StopWords = None, text: str = "prompt") -> DataFrame:
    """Add ``_grams``: all 1..``longest``-grams of the text; stop words are removed before the grams are formed
    (a list, or the name of a language whose list Spark ML ships).

    Each length is the previous one zipped with the tokens that follow, in its own projection, so nothing is computed
    twice.
    """
    tokens = words(F.col(text))
    stop = StopWordsRemover.loadDefaultStopWords(stop_words) if isinstance(stop_words, str) else stop_words
    if stop:
        tokens = F.filter(tokens, lambda t: ~t.isin(stop))
    out = df.withColumn("_gram_1", tokens)
    first = F.col("_gram_1")
    for k in range(2, longest + 1):
        count = F.greatest(F.size(first) - (k - 1), F.lit(0))
        heads, tails = F.slice(F.col(f"_gram_{k - 1}"), 1, count), F.slice(first, F.lit(k), count)
        out = out.withColumn(f"_gram_{k}", F.zip_with(heads, tails, lambda a, b: F.concat(a, F.lit(" "), b)))
    lengths = [f"_gram_{k}" for k in range(1, longest + 1)]
    return out.withColumn("_grams", F.concat(*lengths)).drop(*lengths)


def exploded(df: DataFrame, array: str | Column, name: str, *keep: str) -> DataFrame:
    """One row per array element.

    A plain ``explode`` lets the optimizer infer ``size(array) > 0`` and push it towards the scan, where the whole
    array expression is computed once more for every row.  The outer form followed by a null test does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def ngram_counts(df: DataFrame, longest: int = LEAK_NGRAMS, stop_words: StopWords = None) -> DataFrame:
    """Corpus frequency per n-gram; equal grams combine inside every map task before the shuffle."""
    grams = exploded(with_ngrams(df, longest, stop_words), "_grams", "gram")
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def top_ngrams(counts: DataFrame, size: int) -> DataFrame:
    """Vocabulary: the most frequent grams, ties in text order."""
    return counts.orderBy(F.col("n").desc(), "gram").limit(size)


def frequent_codes(grams: DataFrame, size: int) -> tuple[list[int], int] | None:
    """The 64-bit codes of ``gram`` that are as frequent as the ``size``-th one, and how often that one is there.

    None where there are fewer codes, or too many tie with it.  A code counts at least as much as each of its grams.
    """
    codes = grams.groupBy(F.xxhash64("gram").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    best = codes.orderBy(F.col("n").desc(), "code").limit(CODES_A_GRAM * size).collect()  # bounded by ``size``
    if len(best) < size or len(best) == CODES_A_GRAM * size and best[-1]["n"] == best[size - 1]["n"]:
        return None
    least = best[size - 1]["n"]
    return [r["code"] for r in best if r["n"] >= least], least


def most_frequent(df: DataFrame, size: int, longest: int = LEAK_NGRAMS, stop_words: StopWords = None,
                  sums: list[Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """gram, n and ``sums`` (over the columns in ``keep``) of the ``size`` most frequent grams, ties in text order.

    Grams are counted by 64-bit codes first, so that no text is moved but that of the grams whose codes are as frequent as
    the last one needed.  A code counts at least as much as each of its grams, so these hold all that are asked for unless
    fewer than ``size`` of them are so frequent themselves; then, and where too many codes tie at the border, all grams are
    counted by their texts.
    """
    grams = exploded(with_ngrams(df, longest, stop_words), "_grams", "gram", *keep)

    def counted(rows: DataFrame) -> DataFrame:
        return top_ngrams(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), *(sums or [])), size)

    known = frequent_codes(grams, size)
    if known is None:
        return counted(grams)
    codes, least = known
    heavy = df.sparkSession.createDataFrame([(c,) for c in codes], "code bigint")
    found = stored(counted(grams.join(F.broadcast(heavy), F.xxhash64("gram") == heavy["code"], "left_semi")), "frequent_grams")
    if found.where(F.col("n") >= least).count() < size:
        return counted(grams)
    return found


def ngram_bias(df: DataFrame, first: str = "adversarial", second: str = "benign", longest: int = LEAK_NGRAMS,
               vocabulary: int = LEAK_VOCABULARY, top: int = 20, stop_words: StopWords = None) -> DataFrame:
    """Grams whose mean count per prompt differs most between two labels.

    Prompts without the gram count as zero in the mean.  Both label sums are counted for the vocabulary alone.
    """
    labels = [F.count_if(F.col("label") == first).alias("_a"), F.count_if(F.col("label") == second).alias("_b")]
    sizes = df.agg(F.struct(
        F.count_if(F.col("label") == first).alias("a"), F.count_if(F.col("label") == second).alias("b")
    ).alias("s")).scalar()  # one subquery for both sizes
    known = most_frequent(df, vocabulary, longest, stop_words, labels, ("label",)).select(
        "gram",
        (F.col("_a") / sizes["a"]).alias("mean_first"),
        (F.col("_b") / sizes["b"]).alias("mean_second"),
    )
    biased = known.withColumn("difference", F.abs(F.col("mean_first") - F.col("mean_second")))
    return biased.orderBy(F.col("difference").desc(), "gram").limit(top)


def vocabulary_of(df: DataFrame, size: int, longest: int, stop_words: StopWords = None) -> list[str]:
    """The ``size`` most frequent grams in text order.  ``size`` bounds what comes to the driver."""
    return sorted(row["gram"] for row in most_frequent(df, size, longest, stop_words).collect())


def tfidf_long(df: DataFrame, size: int = BASELINE_VOCABULARY, longest: int = BASELINE_NGRAMS,
               stop_words: StopWords = None, key: str = "row_id") -> DataFrame:
    """key, gram, weight of the ``size`` most frequent grams: smoothed idf + 1, rows of unit length.

    The vocabulary comes first, from counts that combine in every map task; then only its grams leave their rows, and
    document frequency and row length come from that table.
    """
    known = vocabulary_of(df, size, longest, stop_words)
    kept = with_ngrams(df, longest, stop_words).withColumn("_grams", F.filter("_grams", lambda g: g.isin(known)))
    counted = stored(exploded(kept, "_grams", "gram", key).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf")), "gram_counts")
    every = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    frequency = counted.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))  # at most ``size`` rows
    idf = frequency.select("gram", (F.log((1.0 + every) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    weighed = counted.join(F.broadcast(idf), "gram").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighed.select(key, "gram", (F.col("w") / length).alias("weight"))


class TfIdf:
    """TF-IDF with smoothed idf + 1 and unit length, as Spark ML stages over a bounded vocabulary."""

    def __init__(self, size: int = BASELINE_VOCABULARY, longest: int = BASELINE_NGRAMS,
                 stop_words: StopWords = None):
        self.size, self.longest, self.stop_words = size, longest, stop_words

    def _grams(self, df: DataFrame) -> DataFrame:
        return with_ngrams(df, self.longest, self.stop_words)

    def _fit_vocabulary(self, train: DataFrame, text: str) -> DataFrame:
        """Finds the vocabulary; gives ``train`` without its texts, with ``_grams`` that hold all of the vocabulary.

        Grams whose codes are frequent are stored by row, so that one pass over the texts serves the exact counts and the
        features.
        """
        rows = with_ngrams(train, self.longest, self.stop_words, text)
        known = frequent_codes(exploded(rows, "_grams", "gram"), self.size)
        if known is not None:
            codes, least = known
            kept = rows.withColumn("_grams", F.filter("_grams", lambda g: F.xxhash64(g).isin(codes))).drop(text)
            kept = stored(kept, "frequent_grams")
            counts = exploded(kept, "_grams", "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
            best = top_ngrams(counts, self.size).collect()
            if sum(r["n"] >= least for r in best) >= self.size:
                self.vocabulary = sorted(r["gram"] for r in best)
                return kept
        counts = exploded(rows, "_grams", "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        self.vocabulary = sorted(r["gram"] for r in top_ngrams(counts, self.size).collect())
        return rows.drop(text)

    def fit(self, train: DataFrame) -> TfIdf:
        self.fit_transform(train)
        return self

    def fit_transform(self, train: DataFrame, text: str = "prompt") -> DataFrame:
        """``train`` without its texts, with ``features``; counts are stored, so that all passes of a fit read these."""
        grams = self._fit_vocabulary(train, text)
        self.counter = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="_grams", outputCol="_tf")
        counted = stored(self.counter.transform(grams).drop("_grams"), "term_counts")
        idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted).idf
        self.weights = ElementwiseProduct(
            scalingVec=Vectors.dense([value + 1.0 for value in idf]), inputCol="_tf", outputCol="_weighted"
        )
        self.normalizer = Normalizer(p=2.0, inputCol="_weighted", outputCol="features")
        return self._weighted(counted)

    def _weighted(self, counted: DataFrame) -> DataFrame:
        return self.normalizer.transform(self.weights.transform(counted)).drop("_tf", "_weighted")

    def transform(self, df: DataFrame) -> DataFrame:
        return self._weighted(self.counter.transform(self._grams(df)).drop("_grams"))

    def long_weights(self, df: DataFrame, key: str = "row_id") -> DataFrame:
        """One row per prompt and gram with a weight."""
        pairs = F.arrays_zip(strings(self.vocabulary).alias("gram"), vector_to_array("features").alias("weight"))
        present = F.filter(pairs, lambda p: p["weight"] > 0)
        return exploded(self.transform(df), present, "p", key).select(
            key, F.col("p.gram").alias("gram"), F.col("p.weight").alias("weight")
        )
