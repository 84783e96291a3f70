"""Small example sets for trying a model and for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingospan.schemas import EXAMPLE_DDL, literal_frame

# Own sentences: a premise, a hypothesis and their language.
EXAMPLE_PAIRS = [
    ("Two children build a tower of wooden blocks.", "Somebody is playing.", "English"),
    ("The last train left before midnight.", "A train is still waiting.", "English"),
    ("She planted tomatoes behind the shed.", "The shed is painted red.", "English"),
    ("Der Bäcker öffnet schon um fünf Uhr.", "Die Bäckerei ist früh offen.", "German"),
    ("Im Winter friert der See zu.", "Der See hat nie Eis.", "German"),
    ("图书馆今天下午关门。", "今晚不能去图书馆借书。", "Chinese"),
    ("他每天走路上班。", "他开车上班。", "Chinese"),
    ("La rivière déborde après la pluie.", "Il y a beaucoup d'eau.", "French"),
    ("Le marché ouvre le samedi.", "Le marché est loin de la gare.", "French"),
    ("El panadero cerró la tienda al mediodía.", "La tienda está abierta por la tarde.", "Spanish"),
    ("نامت الطفلة بعد العشاء.", "الطفلة مستيقظة.", "Arabic"),
    ("Поезд опоздал на два часа.", "Поезд пришёл вовремя.", "Russian"),
    ("駅前に新しい本屋ができた。", "駅の近くで本が買える。", "Japanese"),
]

# Own sentences: one per language for token statistics.
TOKEN_TEXTS = [
    ("en", "Seven small boats waited near the old stone bridge."),
    ("de", "Sieben kleine Boote warteten an der alten Steinbrücke."),
    ("zh", "七条小船在古老的石桥旁等待。"),
    ("ar", "انتظرت سبعة قوارب صغيرة قرب الجسر الحجري القديم."),
    ("ru", "Семь маленьких лодок ждали у старого каменного моста."),
    ("ja", "七隻の小舟が古い石橋のそばで待っていた。"),
]


def example_pairs(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, EXAMPLE_PAIRS, EXAMPLE_DDL)


def token_texts(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, TOKEN_TEXTS, "lang STRING, text STRING")
