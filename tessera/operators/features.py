"""Sentence features (B6-B13, B22) and lexicon lookups.

The nine named features per sentence are all Catalyst expressions:

    position, lead                       (B6)
    sent_pos, sent_neg, sent_subj        (B8, R2)
    bias_lex                             (B9, R3)
    has_quotes, has_modal                (B10, B11)
    len                                  (B12)

Lexicon lookups pick a strategy from the lexicon size (counted with a cap,
never assumed):

* ``inline``  (<= INLINE_MAX_TERMS, as planning a literal set is slow beyond): the terms become a hash-set literal
  (``INSET``) inside the expression. Row-local, no join, no shuffle; works
  inside ``transform`` over an article's sentence array.
* ``arrow`` (<= BROADCAST_MAX_TERMS, the automatic choice): the lexicon is
  broadcast once (size-checked) and every token of an Arrow batch is looked
  up in a per-worker pandas hash index; counts are summed per list. All
  input columns pass through: no join, no shuffle.
* ``broadcast`` (explicit, C1/C2 as joins; refused above BROADCAST_MAX_TERMS): tokens
  are exploded, matched with a broadcast hash join and counted per sentence row.
* ``salted``: shuffle join where every lexicon row is replicated SALT times
  and every token row carries a hashed salt, so a hot token (``the``) is
  spread over SALT tasks instead of one.

The join forms give every sentence row a number of its own, which travels with
its tokens, and the row's columns travel with its first token. So rows are
never matched by ``(article_id, pos)``, which repeated articles would share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_in, has_modal, has_quotes, tokens

FEATURE_NAMES = ("position", "lead", "sent_pos", "sent_neg", "sent_subj",
                 "bias_lex", "has_quotes", "has_modal", "len")
POSITION_FEATURES = FEATURE_NAMES[:2]
LEXICON_FEATURES = FEATURE_NAMES[2:]

INLINE_MAX_TERMS = 1_000
BROADCAST_MAX_TERMS = 5_000_000
SALT = 64


@dataclass(frozen=True)
class InlineLexicons:
    bias: tuple = ()
    positive: tuple = ()
    negative: tuple = ()


@dataclass
class FeatureContext:
    """The three lookups of a run: bias terms, subjectivity words, vectors."""

    bias_terms: DataFrame            # (term string), distinct
    subjectivity: DataFrame          # (word string, polarity string), unique word
    vectors: DataFrame | None = None  # (article_id, pos int, vec array<float>)
    _inline: InlineLexicons | None = field(default=None, repr=False)
    _sizes: tuple | None = field(default=None, repr=False)
    _rows: dict = field(default_factory=dict, repr=False)
    _bc: tuple | None = field(default=None, repr=False)

    def sizes(self, cap: int = BROADCAST_MAX_TERMS) -> tuple[int, int]:
        """Lexicon row counts, each counted up to ``cap + 1``."""
        if self._sizes is None:
            sizes = []
            for name, df in (("bias", self.bias_terms.select("term")),
                             ("polarity", self.subjectivity.select("word", "polarity"))):
                rows = df.limit(INLINE_MAX_TERMS + 1).collect()  # sizes and fetches a small lexicon
                small = len(rows) <= INLINE_MAX_TERMS
                self._rows[name] = rows if small else None
                sizes.append(len(rows) if small else df.limit(cap + 1).count())
            self._sizes = tuple(sizes)
        return self._sizes

    def strategy(self) -> str:
        nb, ns = self.sizes()
        biggest = max(nb, ns)
        if biggest <= INLINE_MAX_TERMS:
            return "inline"
        if biggest <= BROADCAST_MAX_TERMS:
            return "arrow"
        return "salted"

    def broadcast_lexicon(self):
        """(uuid key, broadcast of (terms, bit flags)) for the Arrow tier;
        only after the size check (bit 0 positive, 1 negative, 2 bias)."""
        if self._bc is None:
            import uuid

            nb, ns = self.sizes()
            if max(nb, ns) > BROADCAST_MAX_TERMS:
                raise ValueError("lexicon too large to broadcast; use the salted join")
            rows = _lexicon_table(self).collect()
            terms = [r.token for r in rows]
            codes = [r.is_pos | (r.is_neg << 1) | (r.is_bias << 2) for r in rows]
            spark = self.bias_terms.sparkSession
            self._bc = (uuid.uuid4().hex, spark.sparkContext.broadcast((terms, codes)))
        return self._bc

    def inline(self) -> InlineLexicons:
        """Collect the lexicons as literals; only after their size was checked."""
        if self._inline is None:
            nb, ns = self.sizes()
            if max(nb, ns) > INLINE_MAX_TERMS:
                raise ValueError("lexicon too large to inline; use the join strategy")
            bias = tuple(sorted(r[0] for r in self._rows["bias"]))
            pol = self._rows["polarity"]
            self._inline = InlineLexicons(
                bias=bias,
                positive=tuple(sorted(r[0] for r in pol if r[1] == "positive")),
                negative=tuple(sorted(r[0] for r in pol if r[1] == "negative")),
            )
        return self._inline


def feature_columns(sentence: Column, pos: Column, toks: Column,
                    lex: InlineLexicons | None, use_lexicons: bool = True
                    ) -> list[tuple[str, Column]]:
    """Named double-valued feature expressions for one sentence."""
    out = [("position", pos.cast("double")),
           ("lead", (pos == 0).cast("double"))]
    if use_lexicons:
        lex = lex or InlineLexicons()
        p = count_in(toks, lex.positive)
        n = count_in(toks, lex.negative)
        out += [("sent_pos", p.cast("double")),
                ("sent_neg", n.cast("double")),
                ("sent_subj", (p + n).cast("double")),
                ("bias_lex", count_in(toks, lex.bias).cast("double")),
                ("has_quotes", has_quotes(sentence).cast("double")),
                ("has_modal", has_modal(sentence).cast("double")),
                ("len", F.size(toks).cast("double"))]
    return out


def feature_names(use_lexicons: bool = True) -> tuple[str, ...]:
    return FEATURE_NAMES if use_lexicons else POSITION_FEATURES


# --------------------------------------------------------------------- long rows
def _lexicon_table(ctx: FeatureContext) -> DataFrame:
    """(token, is_pos, is_neg, is_bias) over the union of both lexicons."""
    subj = ctx.subjectivity.select(
        F.col("word").alias("token"),
        (F.col("polarity") == "positive").cast("int").alias("is_pos"),
        (F.col("polarity") == "negative").cast("int").alias("is_neg"),
        F.lit(0).alias("is_bias"))
    bias = ctx.bias_terms.select(F.col("term").alias("token"), F.lit(0).alias("is_pos"),
                                 F.lit(0).alias("is_neg"), F.lit(1).alias("is_bias"))
    return (subj.unionByName(bias).groupBy("token")
            .agg(F.max("is_pos").alias("is_pos"), F.max("is_neg").alias("is_neg"),
                 F.max("is_bias").alias("is_bias")))


def _joined_counts(sents: DataFrame, ctx: FeatureContext, strategy: str) -> DataFrame:
    """``sents`` with ``_len`` (tokens) and per-sentence lexicon counts via a join.

    Equal tokens of a row are counted before the join. The row's columns go
    with its first token only, so a sentence's text is shuffled once per
    exchange, not once per token."""
    lex = _lexicon_table(ctx)
    rows = sents.withColumn("_toks", tokens("sentence"))
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), "_toks",
                       F.struct(*sents.columns, F.size("_toks").alias("_len")).alias("_s"))
    toks = rows.select("_row", "_s", F.posexplode_outer(
        F.transform(F.array_distinct("_toks"), lambda t: F.struct(
            t.alias("token"),
            F.size(F.filter("_toks", lambda u: u == t)).alias("times")))).alias("tpos", "tk"))
    toks = toks.select("_row", "tk.token", "tk.times",
                       F.when(F.coalesce("tpos", F.lit(0)) == 0, F.col("_s")).alias("_s"))
    if strategy == "broadcast":
        if max(ctx.sizes()) > BROADCAST_MAX_TERMS:
            raise ValueError("lexicon too large to broadcast; use the salted join")
        matched = toks.join(F.broadcast(lex), "token", "left")
    else:
        salted_lex = lex.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted_tok = toks.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALT)).cast("int"))
        matched = salted_tok.join(salted_lex, ["token", "salt"], "left")
    counts = [F.sum(F.col("times") * F.col(c)).alias(n)
              for c, n in (("is_pos", "_p"), ("is_neg", "_n"), ("is_bias", "_b"))]
    whole = matched.groupBy("_row").agg(F.first("_s", ignorenulls=True).alias("_s"), *counts)
    return whole.select("_s.*", "_p", "_n", "_b")


def _arrow_counted(df: DataFrame, ctx: FeatureContext, tokens_col: str, nested: bool) -> DataFrame:
    """Append ``_p, _n, _b`` lexicon counts computed row-locally in Arrow
    batches (no join, no shuffle); nested = per-sentence count arrays."""
    from pyspark.sql import types as T

    from .lexicon_kernels import make_counter
    key, bc = ctx.broadcast_lexicon()
    kind = T.ArrayType(T.IntegerType()) if nested else T.IntegerType()
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, kind) for n in ("_p", "_n", "_b")])
    return df.mapInArrow(make_counter(bc, key, tokens_col, nested), schema)


def sentence_features(sents: DataFrame, ctx: FeatureContext | None,
                      use_lexicons: bool = True, strategy: str = "auto") -> DataFrame:
    """Add the feature columns (doubles) to sentence rows.

    ``sents`` needs ``article_id, pos, sentence``; other columns pass through.
    """
    passthrough = [c for c in sents.columns]
    if not use_lexicons or ctx is None:
        cols = feature_columns(F.col("sentence"), F.col("pos"), F.lit(None), None, False)
        return sents.select(*passthrough, *[c.alias(n) for n, c in cols])
    if strategy == "auto":
        strategy = ctx.strategy()
    if strategy == "inline":
        lex = ctx.inline()
        staged = sents.withColumn("_toks", tokens("sentence"))
        cols = feature_columns(F.col("sentence"), F.col("pos"), F.col("_toks"), lex, True)
        return staged.select(*passthrough, *[c.alias(n) for n, c in cols])
    if strategy == "arrow":
        joined = _arrow_counted(sents.withColumn("_toks", tokens("sentence")), ctx, "_toks", False)
        joined = joined.withColumn("_len", F.size("_toks"))
    else:
        joined = _joined_counts(sents, ctx, strategy)
    p = F.coalesce("_p", F.lit(0)).cast("double")
    n = F.coalesce("_n", F.lit(0)).cast("double")
    return joined.select(
        *passthrough,
        F.col("pos").cast("double").alias("position"),
        (F.col("pos") == 0).cast("double").alias("lead"),
        p.alias("sent_pos"), n.alias("sent_neg"), (p + n).alias("sent_subj"),
        F.coalesce("_b", F.lit(0)).cast("double").alias("bias_lex"),
        has_quotes("sentence").cast("double").alias("has_quotes"),
        has_modal("sentence").cast("double").alias("has_modal"),
        F.col("_len").cast("double").alias("len"),
    )


# ------------------------------------------------------------------ article rows
def with_feature_arrays(articles: DataFrame, ctx: FeatureContext | None,
                        use_lexicons: bool = True, strategy: str = "auto",
                        out: str = "feats") -> DataFrame:
    """Add ``feats array<struct<name: double ...>>`` aligned with ``sentences``.

    With inline lexicons this stays on the article row (``transform``), so the
    whole feature step is a narrow, shuffle-free projection. Larger lexicons
    go through the sentence-row join and are regrouped by article_id.
    """
    names = feature_names(use_lexicons)
    if strategy == "auto":
        strategy = ctx.strategy() if (use_lexicons and ctx is not None) else "inline"
    if strategy == "inline":
        lex = ctx.inline() if (use_lexicons and ctx is not None) else None
        staged = articles.withColumn(
            "_z", F.arrays_zip(F.col("sentences").alias("s"),
                               F.transform("sentences", tokens).alias("t")))

        def per_sentence(z, i):
            cols = feature_columns(z["s"], i, z["t"], lex, use_lexicons)
            return F.struct(*[c.alias(n) for n, c in cols])

        return staged.withColumn(out, F.transform("_z", per_sentence)).drop("_z")
    if strategy == "arrow":
        staged = articles.withColumn("_tk", F.transform("sentences", tokens))
        counted = _arrow_counted(staged, ctx, "_tk", True)
        z = F.arrays_zip(F.col("sentences").alias("s"), F.col("_tk").alias("t"), F.col("_p").alias("p"),
                         F.col("_n").alias("n"), F.col("_b").alias("b"))

        def from_counts(r, i):
            p, n = r["p"].cast("double"), r["n"].cast("double")
            return F.struct(i.cast("double").alias("position"), (i == 0).cast("double").alias("lead"),
                            p.alias("sent_pos"), n.alias("sent_neg"), (p + n).alias("sent_subj"),
                            r["b"].cast("double").alias("bias_lex"),
                            has_quotes(r["s"]).cast("double").alias("has_quotes"),
                            has_modal(r["s"]).cast("double").alias("has_modal"),
                            F.size(r["t"]).cast("double").alias("len"))

        return counted.withColumn(out, F.transform(z, from_counts)).drop("_tk", "_p", "_n", "_b")
    # one number per article row; its columns travel with the first sentence
    rows = articles.select(F.monotonically_increasing_id().alias("_art"), F.struct("*").alias("_a"))
    long = rows.select("_art", "_a", F.posexplode_outer("_a.sentences").alias("pos", "sentence"))
    long = long.withColumn("_a", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("_a")))
    long = sentence_features(long, ctx, use_lexicons, strategy)
    feats = F.when(F.col("pos").isNotNull(), F.struct("pos", *names))  # null for an empty article
    grouped = long.groupBy("_art").agg(F.first("_a", ignorenulls=True).alias("_a"),
                                       F.sort_array(F.collect_list(feats)).alias("_fs"))
    return grouped.select("_a.*", F.transform(
        "_fs", lambda s: F.struct(*[s[n].alias(n) for n in names])).alias(out))


def rule_predictions(feats: Column, feature: str, above: float = 0.0) -> Column:
    """Rule model: sentence predicted 1 when ``feature > above`` (array form)."""
    return F.transform(feats, lambda f: (f[feature] > above).cast("int"))
