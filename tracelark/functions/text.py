"""Text normalisation as column expressions; only the stemmer leaves the JVM (Arrow batches, a memo of words)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .stemmer import stem

#: The default stop words: function words of English, written down for this engine from general grammar. Give another list where results must follow one.
STOPWORDS = tuple("""a about above after again against all also although always am among an and any are as at be became because become been before being below between both but by can cannot could did do does doing done down
due during each either else ever every few for from further get had has have having he hence her here hers herself him himself his how however i if in indeed into is it its itself just may me might more most much must my myself
neither never no nor not now of off often on once only onto or other others our ours out over own per perhaps please rather same several shall she should since so some such than that the their theirs them themselves then there
therefore these they this those though through thus to together too toward under until up upon us very was we well were what whatever when where whether which while who whole whom whose why will with within without would yet you your yours""".split())


def clean_characters(c: Column) -> Column:
    """Letters only: everything else becomes one space; the plural of the acronym UAV loses its s."""
    only = F.trim(F.regexp_replace(c, "[^a-zA-Z]+", " "))
    return F.regexp_replace(only, r"\bUAVs\b", "UAV")


def split_acronyms(c: Column) -> Column:
    """An s after a capital, at the end of a word or before a capital, becomes a word of its own."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"s(?<=\p{Lu}s)(?=$|\s|\p{Lu})", " s "), " {2,}", " "))


#: Fixed value: where a name is cut; results must follow it.
CAMEL = "(?<=[A-Z])(?=[A-Z][a-z])|(?<=[^A-Z])(?=[A-Z])|(?<=[A-Za-z])(?=[^A-Za-z])"


#: The cuts of CAMEL within words of letters only. It begins with the letter after the cut, so that most places are passed at once.
CAMEL_LETTERS = "[A-Z](?:(?<=[a-z][A-Z])|(?<=[A-Z][A-Z])(?=[a-z]))"


def split_camel(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(split_acronyms(c), CAMEL, " "), " {2,}", " "))


def split_snake(c: Column) -> Column:
    return F.translate(c, "_", " ")


def keep_long(words: Column, least: int = 2) -> Column:
    return F.filter(words, lambda w: F.length(w) >= least)


def drop_stopwords(words: Column, stopwords=STOPWORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    memo: dict[str, str] = {}
    for s in batches:
        out = []
        for words in s:
            if words is None:
                out.append(None)
                continue
            row = []
            for w in words:
                v = memo.get(w)
                if v is None:
                    if len(memo) > 500_000:
                        memo.clear()
                    v = memo[w] = stem(w)
                row.append(v)
            out.append(row)
        yield pd.Series(out, dtype="object")


def raw_words(c: Column) -> Column:
    """Words split by camel case and underscores, in lower case; a final s after a capital is dropped first."""
    return F.filter(F.split(F.lower(split_snake(split_camel(_less_final_s(c)))), r"\s+"), lambda w: w != "")


def _less_final_s(c: Column) -> Column:
    return F.regexp_replace(c, r"s(?<=\p{Lu}s)(?=\s|$)", "")


def clean_words(c: Column) -> Column:
    """raw_words of cleaned characters (letters and single spaces): the same words by fewer steps; those of a text without words are one empty word."""
    cut = F.regexp_replace(split_acronyms(_less_final_s(c)), CAMEL_LETTERS, " $0")
    return F.split(F.lower(F.trim(F.regexp_replace(cut, " {2,}", " "))), " ")


def process_tokens(c: Column, stopwords=STOPWORDS, stemmed: bool = True) -> Column:
    """The tokens of a text: cleaned, split, lowered, without stop words (before and after stemming) and single letters."""
    words = drop_stopwords(clean_words(clean_characters(F.coalesce(c, F.lit("")))), stopwords)
    if stemmed:
        words = drop_stopwords(stem_words(words), stopwords)
    return keep_long(words)


def process_text(c: Column, stopwords=STOPWORDS, stemmed: bool = True) -> Column:
    return F.array_join(process_tokens(c, stopwords, stemmed), " ")


def process_word(c: Column, stopwords=STOPWORDS, stemmed: bool = True) -> Column:
    """One word, perhaps several after splitting (underscores are split here, not removed as by cleaning)."""
    words = drop_stopwords(raw_words(F.coalesce(c, F.lit(""))), stopwords)
    if stemmed:
        words = drop_stopwords(stem_words(words), stopwords)
    return F.array_join(keep_long(words), " ")


process_identifier = process_text


def ir_tokens(c: Column) -> Column:
    """Tokens for the models: split at white space, nothing else."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def strip_tags(c: Column) -> Column:
    """Section tags and hyphens become spaces, ahead of phrase extraction."""
    return F.translate(F.regexp_replace(c, r"(?i)\[(SUMMARY|DESCRIPTION)\]", " "), "-", " ")


def canonical(t1: Column, t2: Column) -> Column:
    """camelCase name of a pair of terms; an empty side gives the other."""
    a, b = F.coalesce(t1, F.lit("")), F.coalesce(t2, F.lit(""))
    upper = F.concat(F.upper(F.substring(b, 1, 1)), F.substr(b, F.lit(2)))
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, upper))


def normalised_pair(c: Column) -> Column:
    """The first two runs of letters in lower case, or null."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z]+"), F.lit(0))
    return F.when(F.size(runs) >= 2, F.slice(runs, 1, 2))


def clean_javadoc(c: Column) -> Column:
    """Text of a block comment, without the asterisks that begin its lines; "" for anything else."""
    inner = F.regexp_extract(F.trim(c), r"(?s)^/\*+(.*?)\*+/$", 1)
    lines = F.transform(F.split(inner, r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*", "")))
    return F.trim(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def score_text(c: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", c)


def link_key(source: Column, target: Column) -> Column:
    return F.concat_ws(" -> ", source, target)


def lemmatise(c: Column, lemmas: dict[str, str]) -> Column:
    """Each word replaced by its lemma in a dictionary (others stay), joined by spaces."""
    words = ir_tokens(c)
    if not lemmas:
        return F.array_join(words, " ")
    table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
