import pytest
from pyspark.sql import functions as F

from grainwise.operators import routing as r
from grainwise.operators.routing import Field

ANALYSES = [
    ("去重后 sku 有几个", "metric"), ("本店会员数", "metric"), ("不同用户的个数", "metric"), ("相同会员只算一次，共几位会员", "metric"),
    ("记录里重复的很多吗", "quality"), ("有没有重复值", "quality"), ("连接库存表之后销售额翻倍", "quality"),
    ("用join接上仓库后 price 变大", "quality"), ("为什么明细数比订单量多", "quality"), ("用join补充仓库", "join"), ("把门店表合并进来", "join"),
    ("哪家门店的销售额最少", "top_n"), ("收入 top 4 的门店", "top_n"), ("各渠道退货笔数", "group_compare"), ("对比不同品类的毛利", "group_compare"),
    ("收入环比", "trend"), ("按月看库存", "trend"), ("forecast 明年营收", "unsupported"), ("给门店做聚类", "unsupported"),
    ("清洗这张表", "cleaning"), ("处理缺失的单价", "cleaning"), ("查看字段", "profile"), ("营收合计", "metric"), ("你好", None),
]
INTENTS = [
    ("总订单与月份走向", "combined"), ("客单价", "overview"), ("类别 top 3", "category"), ("晚到的包裹", "delivery"), ("评价怎么样", "delivery"),
    ("用户增长", "trend"), ("gmv", "overview"), ("员工工资", "unsupported"),
]


def routed(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string")
    return [row[0] for row in df.orderBy("i").select(column(F.col("q"))).collect()]


def test_analysis_types(spark):
    assert routed(spark, [q for q, _ in ANALYSES], r.analysis_type) == [a for _, a in ANALYSES]


def test_intents(spark):
    assert routed(spark, [q for q, _ in INTENTS], r.intent) == [a for _, a in INTENTS]


def test_distinct_counts(spark):
    texts = ["统计订单量", "计算每个订单的平均金额，订单数要去重", "有多少重复订单"]
    assert routed(spark, texts, r.is_distinct_count) == [True, False, False]


@pytest.mark.parametrize("text, n", [
    ("前 7 个地区", 7), ("top 80", 50), ("Top 0", 1), ("前三名", 3), ("前十", 10), ("哪个地区最高", 1), ("销售额排名", 5),
    ("前 99999999999 名", 50), ("说说看", 5),
])
def test_ranked_count(spark, text, n):
    assert routed(spark, [text], r.ranked_count) == [n]


def test_settings(spark):
    texts = ["按季度看送达率", "按周看平均客单价", "每日订单数量", "销售额最低的品类"]
    assert routed(spark, texts, r.aggregation) == ["ratio", "average", "count_distinct", "sum"]
    assert routed(spark, texts, r.time_grain) == ["quarter", "week", "day", "month"]
    assert routed(spark, texts, r.sort_direction) == ["desc", "desc", "desc", "asc"]


def test_actions(spark):
    cases = [
        ("哪个地区的订单金额最多？", "top_n", "clarify"), ("按地区比较 amount 合计，不含运费", "group_compare", "ready"),
        ("比较不同地区的送货成功率", "group_compare", "clarify"), ("按月看送达率趋势", "trend", "unsupported"),
        ("分析各地区销售表现", "group_compare", "clarify"), ("预测下个月销量并训练回归模型", "metric", "unsupported"),
        ("各地区订单数分别是多少", "group_compare", "ready"), ("检查数据质量", "quality", "ready"),
        ("按 amount 汇总金额", "metric", "ready"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, q string, a string, want string")
    got = df.orderBy("i").select(r.action(F.col("q"), F.col("a"), "sales.amount").alias("got"), "want").collect()
    assert [x.got for x in got] == [x.want for x in got]


def test_goal_conflicts(spark):
    cases = [
        ("比较不同地区的送货成功率", "group_compare", "sum", True, "order_id", ["needs_ratio"]),
        ("统计订单量", "metric", "sum", False, "order_id", ["needs_distinct_count"]),
        ("把品类补到订单表", "metric", "sum", False, "order_id", ["needs_join"]),
        ("各地区订单数", "trend", "count_distinct", True, "order_status", ["other_shape_asked", "status_is_no_entity"]),
        ("各地区订单数", "group_compare", "count_distinct", True, "order_id", []),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                               "i int, q string, a string, g string, grouped boolean, e string, want array<string>")
    found = r.goal_conflicts(F.col("q"), F.col("a"), F.col("g"), F.col("grouped"), F.col("e"))
    for row in df.select(found.alias("got"), "want").collect():
        assert row.got == row.want


FIELDS = [Field("order_id", "text", True), Field("amount", "number"), Field("region", "text"), Field("report_date", "date"),
          Field("conversions", "number")]


def test_field_bindings(spark):
    texts = ["按地区比较 amount 合计，不含运费", "按月查看 conversions 合计趋势", "检查数据质量", "各渠道订单数"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string")
    got = [(x.analysis, x.entity_field, x.value_field, x.group_field, x.time_field)
           for x in r.bind_fields(df, "q", FIELDS).orderBy("i").collect()]
    assert got == [
        ("group_compare", "order_id", "amount", "region", None), ("trend", "order_id", "conversions", "region", "report_date"),
        ("quality", None, None, None, None), ("group_compare", "order_id", "amount", None, None),
    ]
    mentions = {(x.question_id, x.field) for x in r.field_mentions(df, "i", "q", FIELDS).collect()}
    assert mentions == {(0, "amount"), (1, "conversions")}


def test_a_spelt_field_binds_itself_or_nothing(spark):
    fields = [*FIELDS, Field("shop.margin", "number"), Field("shop.parcel_id", "text"), Field("a.brand", "text"), Field("b.brand", "text"),
              Field("a.cost", "number"), Field("b.cost", "number")]
    texts = ["不同 Parcel_ID 的个数", "不同 rider_id 的个数", "计算 margin 合计", "计算 weight 合计", "cost 总额", "gmv 合计", "按 brand 分组比较 amount",
             "按 shelf 分组比较 amount", "按地区比较 margin 合计"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string")
    got = {x.q: x for x in r.bind_fields(df, "q", fields).collect()}
    assert [got[t].entity_field for t in texts[:2]] == ["shop.parcel_id", None]
    assert [got[t].value_field for t in texts[2:6]] == ["shop.margin", None, None, "amount"]
    assert [got[t].group_field for t in texts[6:8]] == ["a.brand", None]
    assert (got[texts[8]].value_field, got[texts[8]].group_field) == ("shop.margin", "region")
    assert r.bind_fields(df, "q", []).count() == len(texts)


def test_mentions_are_whole_words(spark):
    assert routed(spark, ["amounts", "the amount, please", "AMOUNT", "my_amount"], lambda q: r.mentions(q, "amount")) == [
        False, True, True, False]


def test_evaluation(spark):
    rows = [("trend", "trend", "trend", 10.0), ("trend", "overview", "trend", 20.0), ("unsupported", "trend", "unsupported", 30.0),
            ("unsupported", "unsupported", "trend", 400.0)]
    df = spark.createDataFrame(rows, "gold string, rule string, model string, ms double")
    row = r.evaluate(df, "gold", "rule", "model").first()
    assert (row.total, row.rule_accuracy, row.model_accuracy, row.lift_points, row.unsupported_recall) == (4, 50.0, 75.0, 25.0, 50.0)
    assert r.latency(df, "ms").first().p95_ms == 400.0
    grid = {x.gold: (x.trend, x.overview, x.unsupported) for x in r.confusion(df, "gold", "rule").collect()}
    assert grid == {"trend": (1, 1, 0), "unsupported": (1, 0, 1)}
