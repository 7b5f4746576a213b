"""Questions routed as a batch: a table of texts in, columns of decisions out.

Everything is an ordered CASE over regular expressions, so a question table of
any size is one scan inside whole-stage code, with no model and no Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions import cells
from grainwise.operators.order_stats import nearest_rank

# The wording each decision rests on. ---------------------------
DELIVERY = "延迟|晚到|配送|送达时间|差评|评价|评论"
CATEGORY = r"(?i)品类|类别|类目|商品类|排名|前五|top\s*5"
TREND = "月度|趋势|变化|增长|高点|月份"
OVERVIEW = "核心|经营指标|总订单|订单量|送达率|客单价"
GROSS_VALUE = "(?i)GMV"

NOT_A_COUNT = "平均|均值|客单价|人均|比例|占比|转化率|送达率|总额|合计|求和|总金额|金额总"
HOW_MANY = "多少|几(?:个|笔|位|条|种)|数量|个数|总数|订单量|订单数|客户数|用户数|商品数"
DISTINCT = "去重|唯一|不同|不重复"
COUNT_ONCE = "(?:重复|相同).{0,12}(?:只|仅).{0,6}(?:算|计|统计).{0,4}(?:一次|一笔|一个|1次)"
QUALITY_WORD = "重复|缺失|异常|质量"
OBJECT_COUNT = "订单量|订单数|客户数|用户数|会员数|商品数|业务对象数量"
MANY_OBJECTS = "(?i)(?:多少|几)(?:个|笔|位|条|种)?.{0,8}(?:订单|客户|用户|会员|商品|sku)"
OBJECTS_MANY = "(?i)(?:订单|客户|用户|会员|商品|sku).{0,8}(?:多少|几(?:个|笔|位|条|种))"

JOIN_WORD = "(?i)关联|合并|连接|join"
MONEY_WORD = "(?i)金额|销售额|gmv|amount|revenue|price"
GROWN_WORD = "放大|变多|变大|多了|增加|翻倍|重复|对不上|不一致"
ROW_COUNT = "行数|记录数|数行|明细数"
ENTITY_COUNT = "订单数|订单量|对象数|去重|唯一"
DIFFERENCE = "不一样|不一致|不同|多|少|为什么|为何|区别|差异"

RANK_N = r"(?i)前\s*(?:\d+|[一二三四五六七八九十百]+)|top\s*\d+|排名|最高|最低"
RANK_WHO = "(?:谁|哪(?:个|些|里|家|类|种)).{0,24}(?:最多|最少|最大|最小)"
RANK_MEASURE = "(?i)(?:金额|销售额|订单量|订单数|数量|amount|gmv).{0,8}(?:最多|最少|最大|最小)"

FORECAST = "(?i)预测|forecast|机器学习|回归|聚类"
CLEANING = "清洗|去除重复(?:行|记录|数据)?|删除重复(?:行|记录|数据)?|数据去重|处理缺失|修复日期"
REPEATED_RECORDS = "重复(?:的)?(?:订单|记录|编号)|(?:订单|记录|编号).{0,8}重复"
QUALITY = ("质量|检查.*(?:异常|缺失|重复)|有哪些.*(?:问题|风险)|能不能用|是否可用|重复统计|算重复|多算|重复值|完全重复")
PROFILE = "数据画像|字段结构|字段类型|多少行|多少列|查看字段"
JOIN = r"(?i)关联|连接|合并|(?:^|[^A-Za-z0-9_])join(?:$|[^A-Za-z0-9_])|(?:品类|类别|分类).{0,12}(?:补到|加到|补充|添加).{0,12}订单"
TREND_STRONG = "趋势|月度|按月|同比|环比|随时间|时间变化"
GROUP = ("各地区|各区域|各品类|各渠道|(?:比较|对比)(?:不同|各个|各)?(?:地区|区域|渠道|品类)"
         "|按[^，。！？]{0,10}(?:地区|区域|品类|渠道|状态)|(?:各(?:种|个)?|不同)(?:订单)?状态|分组|分群")
METRIC = "(?i)总额|合计|平均|均值|比例|率|销售额|金额|gmv|收入|营收"

RATIO = "成功率|送达率|送货率|转化率|退款率|取消率|比例|占比|比率|率(?:[，。！？?]|$)"
ORIGINAL = "原始(?:文件|数据|表)|原(?:文件|数据|表)(?:的|中|全部|所有)"
AVERAGE = "平均|均值|客单价|人均"
QUANTITY = "数量|个数|订单|客户|用户|商品数|去重"
MONEY_SUM = "(?i)金额|销售额|gmv|收入|营收"
QUARTERLY = "季度|按季"
WEEKLY = "按周|周度"
DAILY = "按日|每日|日度"
ASCENDING = "最低|最少|最小|倒数"
WHICH_ONE = "谁|哪个|哪家|哪种"
CHINESE_DIGITS = "一二三四五六七八九十"

AMBIGUOUS_AMOUNT = r"(?i)销售金额|销售额|(?:^|[^A-Za-z0-9_])gmv(?:$|[^A-Za-z0-9_])|收入|营收|金额"
AMOUNT_SCOPE = "不含运费|包含运费|含运费|不含退款|包含退款|扣除退款|含税|不含税"
EXPLICIT_MEASURE = (r"(?i)订单(?:量|数)|客户数|用户数|商品数|数量|金额|销售额|gmv|收入|营收|平均|均值|客单价"
                    r"|(?:^|[^A-Za-z0-9_])(?:amount|price|sales|revenue|count)(?:$|[^A-Za-z0-9_])")
ORDER_TASK = "(?:订单|送达|送货|配送)"
STATUS_FIELD = r"^(?:.*\.)?(?:status|order_status)$|状态"

INTENTS = ("overview", "trend", "combined", "category", "delivery", "unsupported")
ANALYSES = ("unsupported", "cleaning", "quality", "profile", "join", "trend", "top_n", "group_compare", "metric")
GROUPED = ("group_compare", "trend", "top_n")
MOST_RANKED, DEFAULT_RANKED = 50, 5
# -----------------------------------------------------------------------------


def ordered(rules: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """The label of the first rule that holds."""
    label = F.lit(otherwise).cast("string")
    for condition, name in reversed(rules):
        label = F.when(condition, F.lit(name)).otherwise(label)
    return label


def intent(q: Column) -> Column:
    """One of six report intents."""
    trend = q.rlike(TREND)
    overview = q.rlike(OVERVIEW) | (~trend & q.rlike(GROSS_VALUE))
    return ordered([
        (q.rlike(DELIVERY), "delivery"), (q.rlike(CATEGORY), "category"), (trend & overview, "combined"),
        (trend, "trend"), (overview, "overview"),
    ], "unsupported")


def is_distinct_count(q: Column) -> Column:
    distinct = q.rlike(DISTINCT) | q.rlike(COUNT_ONCE)
    objects = q.rlike(OBJECT_COUNT) | q.rlike(MANY_OBJECTS) | q.rlike(OBJECTS_MANY)
    return ((distinct & q.rlike(HOW_MANY)) | (~q.rlike(QUALITY_WORD) & objects)) & ~q.rlike(NOT_A_COUNT)


def is_ranking(q: Column) -> Column:
    return q.rlike(RANK_N) | q.rlike(RANK_WHO) | q.rlike(RANK_MEASURE)


def is_ratio(q: Column) -> Column:
    return cells.trimmed(q).rlike(RATIO)


def is_join_amount_risk(q: Column) -> Column:
    return q.rlike(JOIN_WORD) & q.rlike(MONEY_WORD) & q.rlike(GROWN_WORD)


def is_row_count_difference(q: Column) -> Column:
    return q.rlike(ROW_COUNT) & q.rlike(ENTITY_COUNT) & q.rlike(DIFFERENCE)


def wants_original_scope(q: Column) -> Column:
    return q.rlike(ORIGINAL)


def analysis_type(q: Column) -> Column:
    """One of nine analyses when the wording is strong enough, else NULL."""
    distinct = is_distinct_count(q)
    return ordered([
        (q.rlike(FORECAST), "unsupported"),
        (q.rlike(CLEANING), "cleaning"),
        (is_join_amount_risk(q) | is_row_count_difference(q) | q.rlike(QUALITY) | (q.rlike(REPEATED_RECORDS) & ~distinct),
         "quality"),
        (q.rlike(PROFILE), "profile"),
        (q.rlike(JOIN), "join"),
        (q.rlike(TREND_STRONG), "trend"),
        (is_ranking(q), "top_n"),
        (q.rlike(GROUP), "group_compare"),
        (q.rlike(METRIC) | distinct, "metric"),
    ], None)


def ranked_count(q: Column) -> Column:
    """How many groups a ranking question asks for, between 1 and 50."""
    digits = F.regexp_extract(q, r"(?i)(?:前|top)\s*(\d+)", 1)
    asked = F.when(F.length(digits) > 9, F.lit(MOST_RANKED)).otherwise(digits.try_cast("int"))
    word = F.regexp_extract(q, f"(?i)前\\s*([{CHINESE_DIGITS}])", 1)
    spelled = F.instr(F.lit(CHINESE_DIGITS), word)
    return (
        F.when(asked.isNotNull(), F.least(F.lit(MOST_RANKED), F.greatest(F.lit(1), asked)))
        .when(word != "", spelled)
        .when(is_ranking(q) & q.rlike(WHICH_ONE), F.lit(1))
        .otherwise(F.lit(DEFAULT_RANKED))
    )


def aggregation(q: Column) -> Column:
    return ordered([
        (is_ratio(q), "ratio"),
        (q.rlike(AVERAGE), "average"),
        (is_distinct_count(q), "count_distinct"),
        (q.rlike(QUANTITY) & ~q.rlike(MONEY_SUM), "count_distinct"),
    ], "sum")


def time_grain(q: Column) -> Column:
    return ordered([(q.rlike(QUARTERLY), "quarter"), (q.rlike(WEEKLY), "week"), (q.rlike(DAILY), "day")], "month")


def sort_direction(q: Column) -> Column:
    return F.when(q.rlike(ASCENDING), F.lit("asc")).otherwise(F.lit("desc"))


def _names_field(q: Column, field: str | None) -> Column:
    if not field:
        return F.lit(False)
    short = field.split(".")[-1]
    if re.fullmatch(r"[A-Za-z_]\w*", short):
        return mentions(q, short)
    return F.contains(q, F.lit(short))


def action(q: Column, analysis: Column, value_field: str | None = None) -> Column:
    """ready, clarify or unsupported: what may happen with a planned analysis.

    A ratio over time or as a ranking is not supported; a ratio per group and an
    amount without a stated field or scope must be clarified first.
    """
    ratio, grouped = is_ratio(q), analysis.isin(*GROUPED)
    distinct = is_distinct_count(q)
    vague = q.rlike(AMBIGUOUS_AMOUNT) & ~distinct & ~_names_field(q, value_field) & ~q.rlike(AMOUNT_SCOPE)
    unsupported = F.coalesce(analysis_type(q) == "unsupported", F.lit(False)) | (analysis == "unsupported")
    return ordered([
        (ratio & analysis.isin("trend", "top_n"), "unsupported"),
        (ratio & (analysis == "group_compare"), "clarify"),
        (unsupported, "unsupported"),
        (~(grouped | (analysis == "metric")), "ready"),
        (vague, "clarify"),
        (grouped & ~(distinct | q.rlike(EXPLICIT_MEASURE)), "clarify"),
    ], "ready")


def goal_conflicts(q: Column, analysis: Column, agg: Column, grouped: Column, entity: Column) -> Column:
    """Array of ways a configured analysis departs from what the question asks."""
    wanted = analysis_type(q)
    ratio, distinct = is_ratio(q), is_distinct_count(q)
    rules = [
        (wanted == "join", "needs_join"),
        (wanted == "unsupported", "unsupported_goal"),
        (ratio & (agg != "ratio"), "needs_ratio"),
        ((agg == "ratio") & analysis.isin("trend", "top_n"), "ratio_not_groupable"),
        (distinct & (agg != "count_distinct"), "needs_distinct_count"),
        ((wanted == "metric") & grouped, "grouping_not_asked"),
        (wanted.isin(*GROUPED) & (analysis != wanted), "other_shape_asked"),
        (q.rlike(AVERAGE) & ~ratio & (agg != "average"), "needs_average"),
        (q.rlike(ORDER_TASK) & entity.rlike(STATUS_FIELD), "status_is_no_entity"),
    ]
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in rules]))


def decisions(questions: DataFrame, text: str, value_field: str | None = None) -> DataFrame:
    """The question table with every routing decision as a column."""
    q = cells.col(text)
    wanted = analysis_type(q)
    return questions.withColumns({
        "intent": intent(q),
        "analysis": wanted,
        "distinct_count": is_distinct_count(q),
        "ranking": is_ranking(q),
        "ratio": is_ratio(q),
        "join_amount_risk": is_join_amount_risk(q),
        "row_count_difference": is_row_count_difference(q),
        "original_scope": wants_original_scope(q),
        "aggregation": aggregation(q),
        "grain": time_grain(q),
        "direction": sort_direction(q),
        "n": ranked_count(q),
        "action": action(q, F.coalesce(wanted, F.lit("unsupported")), value_field),
    })


@dataclass(frozen=True)
class Field:
    """What routing may know of a column: its name and statistics, never its cells."""

    name: str
    type: str
    candidate_key: bool = False


def mentions(q: Column, name: str) -> Column:
    """Does the question contain the field name as a whole word?"""
    return q.rlike(rf"(?i)(^|[^A-Za-z0-9_]){re.escape(name)}($|[^A-Za-z0-9_])")


def field_mentions(questions: DataFrame, question_id: str, text: str, fields: list[Field]) -> DataFrame:
    """(question, field) pairs. The fields are a literal list, so there is no join."""
    q = cells.col(text)
    hits = F.array_compact(F.array(*[F.when(mentions(q, f.name), F.lit(f.name)) for f in fields]))
    return questions.select(cells.col(question_id).alias("question_id"), F.explode(hits).alias("field"))


# Wording of a question -> names of the fields it can mean.
ENTITY_WORDS = [
    ("(?i)订单|order", "(?i)order|订单"),
    ("(?i)客户|用户|会员", "(?i)customer|user|member|客户|用户|会员"),
    ("(?i)商品|产品|sku|item", "(?i)sku|item|product|商品|产品"),
]
ENTITY_KEY = "(?i)id|key|code|no|编号|编码|单号"
ENTITY_FALLBACK = "(?i)(?:^|_)(?:order|customer|user|sku|item)_?id|订单|客户|用户|商品.*编号"
GROUP_WORDS = [
    ("(?i)地区|区域", "(?i)region|state|province|地区|区域"),
    ("(?i)渠道", "(?i)channel|渠道"),
    ("(?i)品类|类别|类目", "(?i)category|品类|类别|类目"),
    ("(?i)仓库", "(?i)warehouse|仓库"),
    ("(?i)客户类型|客户分群", "(?i)segment|customer_type|客户类型|客户分群"),
]
GROUP_FALLBACK = "(?i)region|segment|category|warehouse|channel|地区|区域|品类|客户类型|仓库|渠道"
VALUE_FALLBACK = "(?i)amount|sales|gmv|revenue|spend|price|stock_qty|金额|销售额|收入|价格|库存"
TIME_FALLBACK = "(?i)date|time|month|日期|时间|月份"
# Wording that names a field itself; the field is then that one or none.
NAMED_ID = r"(?i)(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_.]*(?:_id|_key|_code))(?![A-Za-z0-9_])"
NAMED_VALUE = [r"(?i)(?:计算|汇总|求和|平均)\s*([A-Za-z_][\w.]*)", r"(?i)([A-Za-z_][\w.]*)\s*(?:合计|总额|求和|平均)"]
NAMED_GROUP = r"(?i)按\s*([A-Za-z_][\w.]*)\s*(?:分组|汇总|比较)"
ANY_VALUE = "(?i)^(?:gmv|revenue|sales)$"


def _first(names: list[str], pattern: str) -> str | None:
    return next((n for n in names if re.search(pattern, n)), None)


def _mentioned(q: Column, names: list[str]) -> Column:
    return F.coalesce(F.lit(None).cast("string"), *[F.when(mentions(q, n), F.lit(n)) for n in names])


def _written(q: Column, *patterns: str) -> Column:
    """The field name a question spells out, by the first pattern that finds one, else NULL."""
    return F.coalesce(*[F.nullif(F.regexp_extract(q, p, 1), F.lit("")) for p in patterns])


def _called(names: list[str], name: Column) -> Column:
    """The fields of that name, with or without a table before it."""
    listed = F.array(*map(F.lit, names)).cast("array<string>")
    return F.filter(listed, lambda n: (n == name) | n.endswith(F.concat(F.lit("."), name)))


def _only(found: Column) -> Column:
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def bind_fields(questions: DataFrame, text: str, fields: list[Field]) -> DataFrame:
    """Entity, value, group and time field each question most likely means.

    Which field answers which wording is settled once from the field list; per
    question only the wording is tested. A question that spells out a field the
    table does not have binds nothing in its place, not a default.
    """
    q = cells.col(text)
    names = [f.name for f in fields]
    numeric = [f.name for f in fields if f.type in ("number", "mixed")]
    key = next((f.name for f in fields if f.candidate_key), None)

    entity = F.lit(key or _first(names, ENTITY_FALLBACK))
    for words, pattern in reversed(ENTITY_WORDS):
        own = [n for n in names if re.search(ENTITY_KEY, n)]
        entity = F.when(q.rlike(words), F.lit(_first(own, pattern))).otherwise(entity)
    named = _mentioned(q, names)
    identifier = F.lower(_written(q, NAMED_ID))
    unfolded = F.array(*map(F.lit, names)).cast("array<string>")
    alike = F.filter(unfolded, lambda n: (F.lower(n) == identifier) | F.lower(n).endswith(F.concat(F.lit("."), identifier)))
    counted = F.when(named.isNotNull(), named).when(identifier.isNotNull(), _only(alike)).otherwise(entity)
    entity = F.when(is_distinct_count(q), counted).otherwise(entity)

    measure = _written(q, *NAMED_VALUE)
    value = (
        F.when(_mentioned(q, numeric).isNotNull(), _mentioned(q, numeric))
        .when(measure.isNotNull() & ~measure.rlike(ANY_VALUE), _only(_called(numeric, measure)))
        .otherwise(F.lit(_first(numeric, VALUE_FALLBACK)))
    )
    by = _written(q, NAMED_GROUP)
    group = F.when(by.isNotNull(), F.get(_called(names, by), F.lit(0))).otherwise(F.lit(_first(names, GROUP_FALLBACK)))
    for words, pattern in reversed(GROUP_WORDS):
        group = F.when(q.rlike(words), F.lit(_first(names, pattern))).otherwise(group)
    dated = next((f.name for f in fields if f.type == "date"), None) or _first(names, TIME_FALLBACK)
    wanted = analysis_type(q)
    nothing = F.lit(None).cast("string")
    measurable = wanted.isin("metric", *GROUPED)
    return questions.withColumns({
        "analysis": wanted,
        "entity_field": F.when(measurable, entity).otherwise(nothing),
        "value_field": F.when(measurable, value).otherwise(nothing),
        "group_field": F.when(wanted.isin(*GROUPED), group).otherwise(nothing),
        "time_field": F.when(wanted.isin("metric", "trend"), F.lit(dated)).otherwise(nothing),
    })


def evaluate(results: DataFrame, gold: str, rule: str, model: str) -> DataFrame:
    """Accuracy of two routers against gold labels, the lift, and recall of refusals."""
    right = {name: F.avg((F.col(name) == F.col(gold)).cast("double")) * 100 for name in (rule, model)}
    refused = F.col(gold) == "unsupported"
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(right[rule], 1).alias("rule_accuracy"),
        F.round(right[model], 1).alias("model_accuracy"),
        F.round(F.round(right[model], 1) - F.round(right[rule], 1), 1).alias("lift_points"),
        F.round(F.avg(F.when(refused, (F.col(model) == "unsupported").cast("double"))) * 100, 1).alias("unsupported_recall"),
    )


def latency(results: DataFrame, column: str) -> DataFrame:
    """Mean and nearest-rank 95th percentile of a latency column, one row."""
    p95 = nearest_rank(results.select(cells.col(column).cast("double").alias("ms")), "ms", 0.95)
    return results.agg(F.round(F.avg(column)).cast("bigint").alias("mean_ms"), F.lit(p95).cast("double").alias("p95_ms"))


def confusion(results: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Gold x predicted counts; both label sets are fixed and small."""
    return results.groupBy(F.col(gold).alias("gold")).pivot(predicted, list(INTENTS)).agg(F.count(F.lit(1))).na.fill(0)
