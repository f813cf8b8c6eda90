"""Findings as rows, and the rule tables that turn them into priorities and advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "source string, kind string, column string, metric string, value double, message string"

# Keywords of each priority; the first matching level wins.
PRIORITY_KEYWORDS = {
    "high": ["外れ値", "異常", "欠損", "品質問題", "変化点"],
    "medium": ["相関", "周期", "季節", "トレンド", "分布"],
    "low": ["稼働", "パターン", "クラスタ"],
}

# Keywords of each insight category; an insight may be in several.
INSIGHT_CATEGORIES = {
    "周期性・季節性": ["周期", "季節", "FFT"],
    "変化点・異常": ["変化点", "異常"],
    "相関・関連性": ["相関", "関連"],
    "稼働パターン": ["稼働", "ピーク", "時間"],
    "プロセス特性": ["プロセス", "成分", "変動"],
}

# Keywords -> interview questions, and the questions that are always asked.
INTERVIEW_RULES = [
    (["欠損"], ["欠損値の発生原因と処理方針について", "欠損期間中の設備の状況について"]),
    (["外れ値"], ["外れ値が発生する典型的な原因について", "設備異常やメンテナンス作業との関連について"]),
    (["相関"], ["高い相関を示す変数間の因果関係について", "工程制御のロジックについて"]),
    (["時間", "時系列"], ["サンプリング頻度の変更履歴について", "データ収集システムの仕様について"]),
    (["分布", "歪み"], ["変数の正常値範囲について", "運転条件や設備の制約について"]),
    (["品質"], ["データ収集・記録プロセスについて", "計測器の校正履歴について"]),
]
GENERAL_QUESTIONS = [
    "データの前処理や補正の方法について",
    "目的変数（水分値）に影響する主要因子について",
    "30分の遅れ時間の妥当性について",
    "予測精度の要求レベルについて",
    "運用時の更新頻度や許容できる計算時間について",
]

# Fixed values: (step, keywords that trigger it, actions); no keywords means always.
NEXT_STEPS = [
    ("データ品質改善", ["欠損", "品質", "異常", "外れ値"], ["欠損値の発生原因をヒアリング", "外れ値の妥当性を確認", "データ収集プロセスの見直し"]),
    ("特徴量エンジニアリング", ["相関"], ["高相関変数の因果関係を調査", "派生変数の作成（比率、差分等）"]),
    ("特徴量エンジニアリング", ["周期", "季節"], ["周期性を活用した時間特徴量の作成", "移動平均等の平滑化特徴量"]),
    ("予測モデル構築準備", [], ["30分遅れ特徴量の効果検証", "特徴量選択手法の適用", "時系列分割による適切な検証設計"]),
    ("ドメイン知識との統合", [], ["工程エンジニアとの発見事項共有", "物理的制約の確認", "業界標準との比較"]),
    ("継続的改善", [], ["定期的なデータ品質モニタリング", "新規データでの再分析", "予測性能の継続評価"]),
]


def mentions(message: Column, keywords: Sequence[str]) -> Column:
    return message.rlike("|".join(keywords))


def finding(df: DataFrame, source: str, kind: str, column, metric: str, value, message: Column) -> DataFrame:
    """Rows of ``df`` as findings."""
    col = column if isinstance(column, Column) else F.lit(column).cast("string")
    return df.select(
        F.lit(source).alias("source"), F.lit(kind).alias("kind"), col.alias("column"), F.lit(metric).alias("metric"),
        (value if isinstance(value, Column) else F.col(value)).cast("double").alias("value"), message.alias("message"),
    )


def with_priority(findings: DataFrame, message: str = "message") -> DataFrame:
    level = F.lit("other")
    for name in ("low", "medium", "high"):
        level = F.when(mentions(F.col(message), PRIORITY_KEYWORDS[name]), name).otherwise(level)
    return findings.withColumn("priority", level)


def by_priority(findings: DataFrame) -> DataFrame:
    return with_priority(findings).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def insight_categories(findings: DataFrame, message: str = "message") -> DataFrame:
    """``category`` per insight, one row for every category it belongs to."""
    hits = [F.when(mentions(F.col(message), words), F.lit(name)) for name, words in INSIGHT_CATEGORIES.items()]
    return findings.withColumn("category", F.explode(F.array_compact(F.array(*hits))))


def _triggered(findings: DataFrame, rules: Sequence[Sequence[str]], message: str) -> DataFrame:
    """Numbers of the rules that any finding triggers, from one aggregate."""
    any_hit = [F.coalesce(F.bool_or(mentions(F.col(message), words)), F.lit(False)) for words in rules]
    flags = F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(any_hit)])
    return findings.agg(F.array_compact(flags).alias("r")).select(F.explode("r").alias("rule"))


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def interview_questions(findings: DataFrame, message: str = "message") -> DataFrame:
    """Questions of every triggered rule in rule order, then the general ones; none without findings."""
    hit = _triggered(findings, [w for w, _ in INTERVIEW_RULES] + [[""]], message)
    rows = [(i, f"{q}") for i, (_, qs) in enumerate(INTERVIEW_RULES) for q in qs]
    rows += [(len(INTERVIEW_RULES), q) for q in GENERAL_QUESTIONS]
    table = _table(findings, [(r, i + 1, q) for i, (r, q) in enumerate(rows)], "rule int, seq int, question string")
    return table.join(F.broadcast(hit), "rule", "left_semi").select("seq", "question")


def next_steps(findings: DataFrame, message: str = "message") -> DataFrame:
    """Recommended actions: conditional ones when triggered, the others always."""
    conditional = [(i, w) for i, (_, w, _) in enumerate(NEXT_STEPS) if w]
    hit = _triggered(findings, [w for _, w in conditional], message).select(
        F.element_at(F.array(*[F.lit(i) for i, _ in conditional]), F.col("rule") + 1).alias("rule")
    )
    always = _table(findings, [(i,) for i, (_, w, _) in enumerate(NEXT_STEPS) if not w], "rule int")
    rows = [(i, step, a) for i, (step, _, actions) in enumerate(NEXT_STEPS) for a in actions]
    table = _table(findings, [(r, n + 1, s, a) for n, (r, s, a) in enumerate(rows)], "rule int, seq int, step string, action string")
    return table.join(F.broadcast(hit.unionByName(always)), "rule", "left_semi").select("seq", "step", "action")
