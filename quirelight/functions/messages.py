"""Messages of the command line, in the languages it speaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "en"
MESSAGES = {
    "en": {
        "run.head": "%s into %s (%s)",
        "run.totals": "%s of %s segments translated, %s pending",
        "run.calls": "%s usable answers of %s calls, %s documents from the store",
        "run.usage": "%s tokens in, %s tokens out",
        "run.unreported": "the service reports no usage",
        "run.notes": "%s problems",
        "run.remarks": "%s remarks",
        "run.more": "and %s more",
        "run.failed": "%s documents failed: %s",
        "run.none": "nothing was translated",
        "run.written": "written to %s",
        "settings.wrong": "the setting %s can't be used",
        "settings.ignored": "the settings file is ignored: %s",
        "models.none": "the service names no model",
    },
    "fr": {
        "run.head": "%s vers %s (%s)",
        "run.totals": "%s segments traduits sur %s, %s en attente",
        "run.calls": "%s réponses utilisables sur %s appels, %s documents repris",
        "run.usage": "%s jetons lus, %s jetons écrits",
        "run.unreported": "le service n'indique pas sa consommation",
        "run.notes": "%s problèmes",
        "run.remarks": "%s remarques",
        "run.more": "et %s de plus",
        "run.failed": "%s documents en échec : %s",
        "run.none": "rien n'a été traduit",
        "run.written": "écrit dans %s",
        "settings.wrong": "le réglage %s ne convient pas",
        "settings.ignored": "le fichier de réglages est ignoré : %s",
        "models.none": "le service ne nomme aucun modèle",
    },
}


def message(key: str, locale: str = DEFAULT, *args) -> str:
    """The message of ``key``, in English where the language lacks it, else the key itself; with arguments it is a template."""
    text = MESSAGES.get(locale, {}).get(key) or MESSAGES[DEFAULT].get(key, key)
    return text % args if args else text


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(locale, key, text) for locale, own in MESSAGES.items() for key, text in own.items()], "locale string, key string, text string")


def looked_up(keys: DataFrame, messages: DataFrame, fallback: str = DEFAULT) -> DataFrame:
    """``keys`` (locale, key, more) with ``text``: in their language, else in the fallback's, else the key itself."""
    own = messages.select("locale", "key", F.col("text").alias("_own"))
    other = messages.where(F.col("locale") == fallback).select("key", F.col("text").alias("_other"))
    return keys.join(own, ["locale", "key"], "left").join(other, "key", "left").withColumn("text", F.coalesce("_own", "_other", "key")).drop("_own", "_other")


def templated(template, *arguments):
    """A printf template with its arguments, as a Column."""
    return F.call_function("format_string", template, *arguments)


def unmatched(messages: DataFrame, one: str, two: str) -> DataFrame:
    """(key, only_in): keys of one language that the other lacks, both ways."""
    keys = lambda x: messages.where(F.col("locale") == x).select("key").distinct()
    side = lambda a, b: keys(a).join(keys(b), "key", "left_anti").withColumn("only_in", F.lit(a))
    return side(one, two).unionByName(side(two, one))
