"""Projections, filters and derived columns: P1-P19."""

from pyspark.sql import functions as F

from millrace.functions import recode as rc
from millrace.plans.registry import query


@query("P1_select_drop", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def _(t):
    return t.orders.drop("o_orderstatus", "o_orderpriority")


@query("P2_equality_filter", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size = 11")
def _(t):
    return t.part.filter((F.col("p_type") == "ECONOMY") & (F.col("p_size") == 11)).select("p_partkey", "p_name", "p_brand")


@query("P3_date_between", """
SELECT o_orderkey, o_custkey, o_orderdate FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'""")
def _(t):
    window = F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-03-31").cast("timestamp_ntz"))
    return t.orders.filter(window).select("o_orderkey", "o_custkey", "o_orderdate")


@query("P4_category_and_search", """
SELECT doc_id, lang, source FROM documents
WHERE lang IN ('en', 'fr') AND (coalesce(contains(lower(text), 'the and'), false) OR coalesce(contains(lower(source), 'the and'), false))""")
def _(t):
    return rc.search(t.documents.filter(F.col("lang").isin("en", "fr")), "The and", ["text", "source"]).select("doc_id", "lang", "source")


@query("P4_search_pattern", r"""
SELECT doc_id, source FROM documents WHERE coalesce(regexp_matches(lower(source), 'src1[0-4]$'), false)""")
def _(t):
    return rc.search(t.documents, "src1[0-4]$", ["source"], regex=True).select("doc_id", "source")


BRANDS = {"Brand#1": "North", "Brand#2": "North", "Brand#3": "South", "Brand#4": "South", "Brand#5": "East", "Brand#6": "West"}
LUXURY = """CASE WHEN maker IN ('Land Rover','Jaguar','Audi','Bentley','Porsche','Volvo','Lamborghini')
  OR grp IN ('BMW','Mercedes-Benz') THEN 'Luxury' ELSE 'Regular' END"""
MAKERS = {"Brand#1": "Audi", "Brand#2": "Porsche", "Brand#3": "MINI", "Brand#4": "Skoda", "Brand#5": "Jaguar", "Brand#6": "Kia"}


@query("P5_brand_recode", """
SELECT p_partkey, p_brand, CASE p_brand WHEN 'Brand#1' THEN 'North' WHEN 'Brand#2' THEN 'North' WHEN 'Brand#3' THEN 'South'
  WHEN 'Brand#4' THEN 'South' WHEN 'Brand#5' THEN 'East' WHEN 'Brand#6' THEN 'West' ELSE p_brand END AS brand_group FROM part""")
def _(t):
    return t.part.select("p_partkey", "p_brand", rc.recode(F.col("p_brand"), BRANDS).alias("brand_group"))


@query("P5_maker_group_and_luxury", f"""
SELECT p_partkey, maker, grp AS car_brand, {LUXURY} AS luxury_vs_regular FROM (
  SELECT *, CASE maker WHEN 'Audi' THEN 'Volkswagen' WHEN 'Porsche' THEN 'Volkswagen' WHEN 'MINI' THEN 'BMW'
    WHEN 'Skoda' THEN 'Volkswagen' WHEN 'Jaguar' THEN 'Tata' WHEN 'Kia' THEN 'Hyundai' ELSE maker END AS grp
  FROM (SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'Audi' WHEN 'Brand#2' THEN 'Porsche' WHEN 'Brand#3' THEN 'MINI'
    WHEN 'Brand#4' THEN 'Skoda' WHEN 'Brand#5' THEN 'Jaguar' WHEN 'Brand#6' THEN 'Kia' ELSE p_brand END AS maker FROM part))""")
def _(t):
    maker = rc.recode(F.col("p_brand"), MAKERS)
    group = rc.recode(maker, rc.v.BRAND_GROUPS)
    return t.part.select("p_partkey", maker.alias("maker"), group.alias("car_brand"), rc.luxury_flag(group, maker).alias("luxury_vs_regular"))


@query("P5_region_by_table", """
SELECT c_custkey, n_name, coalesce(r_name, n_name) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT n_name AS old, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'ASIA')) ON n_name = old""")
def _(t):
    mapping = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).filter(F.col("r_name").isin("AFRICA", "ASIA"))
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return rc.recode_by_table(people, "n_name", mapping, "n_name", "r_name", "region")


ANSWERS = """answers AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS party,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS strength,
    CASE WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 200000 THEN 2 WHEN o_totalprice < 300000 THEN 3
         WHEN o_totalprice < 400000 THEN -8 ELSE -1 END AS leaning FROM orders),
coded AS (
  SELECT *, CASE WHEN party = 2 AND strength = 1 THEN 7 WHEN party = 2 AND strength = 2 THEN 6
    WHEN party = 1 AND strength = 1 THEN 1 WHEN party = 1 AND strength = 2 THEN 2
    WHEN leaning = 1 THEN 5 WHEN leaning IN (2, -8, -9) THEN 4 WHEN leaning = 3 THEN 3 ELSE -9 END AS party_code FROM answers)"""


def answers(t):
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        rc.lookup(F.col("o_orderstatus"), {"F": 1, "O": 2}, F.lit(3)).alias("party"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("strength"),
        rc.first_match([(price < 100000, 1), (price < 200000, 2), (price < 300000, 3), (price < 400000, -8)], -1).alias("leaning"),
    )


def coded(t):
    return answers(t).withColumn("party_code", rc.party_code(F.col("party"), F.col("strength"), F.col("leaning")))


@query("P6_party_code", f"""
WITH {ANSWERS} SELECT o_orderkey, party_code,
  CASE WHEN party_code IN (7, 6, 5) THEN 'R' WHEN party_code IN (1, 2, 3) THEN 'D' ELSE 'I' END AS party_letter FROM coded""")
def _(t):
    return coded(t).select("o_orderkey", "party_code", rc.party_letter(F.col("party_code")).alias("party_letter"))


@query("P7_code_cross_check", f"""
WITH {ANSWERS} SELECT o_orderkey, CASE WHEN party_code <> published THEN false ELSE true END AS codes_agree
FROM (SELECT *, CASE WHEN leaning > 0 THEN leaning END AS published FROM coded)""")
def _(t):
    published = F.when(F.col("leaning") > 0, F.col("leaning"))
    return coded(t).select("o_orderkey", rc.codes_agree(F.col("party_code"), published).alias("codes_agree"))


@query("P8_any_code_flag", """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN rating = 1 THEN 0 WHEN rating IN (2, 3, 4, 5) THEN 1 WHEN reason BETWEEN 6 AND 14 THEN 1
       WHEN other BETWEEN 6 AND 14 THEN 1 ELSE -9 END AS had_difficulty
FROM (SELECT *, l_linenumber AS rating, CAST(l_quantity AS INTEGER) AS reason, CAST(round(l_tax * 100) AS INTEGER) AS other FROM lineitem)""")
def _(t):
    flag = rc.had_difficulty(F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.round(F.col("l_tax") * 100).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", flag.alias("had_difficulty"))


CELLS = """cells AS (
  SELECT *, CASE WHEN g = 0 AND m = 0 THEN 'Passive x No Timer' WHEN g = 0 AND m = 1 THEN 'Passive x Timer'
    WHEN g = 1 AND m = 0 THEN 'Active x No Timer' WHEN g = 1 AND m = 1 THEN 'Active x Timer' END AS cell
  FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 END AS g,
               CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS m FROM lineitem))"""


def cells(t):
    group = rc.lookup(F.col("l_returnflag"), {"A": 0, "R": 1})
    timing = rc.lookup(F.col("l_linestatus"), {"O": 0, "F": 1})
    return t.lineitem.withColumn("cell", rc.cell_label(group, timing))


@query("P9_cell_label", f"WITH {CELLS} SELECT l_orderkey, l_linenumber, l_partkey, cell FROM cells")
def _(t):
    return cells(t).select("l_orderkey", "l_linenumber", "l_partkey", "cell")


@query("P10_column_by_cell", f"""
WITH {CELLS} SELECT l_orderkey, l_partkey, cell,
  CASE cell WHEN 'Passive x No Timer' THEN l_quantity WHEN 'Passive x Timer' THEN l_extendedprice
    WHEN 'Active x No Timer' THEN l_discount WHEN 'Active x Timer' THEN l_tax END AS training_1,
  CASE cell WHEN 'Passive x No Timer' THEN l_tax WHEN 'Passive x Timer' THEN l_discount
    WHEN 'Active x No Timer' THEN l_extendedprice WHEN 'Active x Timer' THEN l_quantity END AS training_2 FROM cells""")
def _(t):
    names = list(rc.v.CELL_LABELS.values())
    choices = {
        "training_1": dict(zip(names, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])),
        "training_2": dict(zip(names, ["l_tax", "l_discount", "l_extendedprice", "l_quantity"])),
    }
    return cells(t).select("l_orderkey", "l_partkey", "cell", *rc.pick_by_cell(F.col("cell"), choices))


@query("P11_scale_and_log", """
SELECT c_custkey, c_acctbal / 100000.0::DOUBLE AS balance_in_100k,
  CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 9) END AS log_balance FROM customer""")
def _(t):
    balance = F.col("c_acctbal")
    return t.customer.select("c_custkey", rc.scaled(balance, 100000).alias("balance_in_100k"), F.round(rc.safe_log(balance), 9).alias("log_balance"))


@query("P12_age_and_next_year", """
SELECT o_orderkey, 2001 - CAST(year(o_orderdate) AS INTEGER) AS age_in_years, year(o_orderdate) + 1 = 2001 AS immediate FROM orders""")
def _(t):
    year = F.year("o_orderdate")
    return t.orders.select("o_orderkey", rc.age_in_years(year, 2001).alias("age_in_years"), rc.sold_next_year(year, 2001).alias("immediate"))


QUIZ = """quiz AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_linestatus = 'F' AS keep,
    CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_quantity > 25 THEN 'Phishing' ELSE 'Legitimate' END AS a1,
    CASE WHEN l_discount > 0.05 THEN 'Phishing' ELSE 'Legitimate' END AS a2,
    CASE WHEN l_tax > 0.04 THEN 'Phishing' ELSE 'Legitimate' END AS a3,
    CASE WHEN l_linenumber = 7 THEN 1 WHEN l_linenumber = 1 THEN NULL ELSE 0 END AS gibberish FROM lineitem),
flat AS (SELECT *, CASE WHEN keep AND ((a1 = 'Phishing' AND a2 = 'Phishing' AND a3 = 'Phishing')
    OR (a1 = 'Legitimate' AND a2 = 'Legitimate' AND a3 = 'Legitimate')) THEN 1 END AS flatline FROM quiz)"""


def quiz(t):
    def answer(condition):
        return F.when(condition, "Phishing").otherwise("Legitimate")

    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        (F.col("l_linestatus") == "F").alias("keep"),
        F.when(F.col("l_returnflag") != "N", answer(F.col("l_quantity") > 25)).alias("a1"),
        answer(F.col("l_discount") > 0.05).alias("a2"),
        answer(F.col("l_tax") > 0.04).alias("a3"),
        rc.first_match([(F.col("l_linenumber") == 7, 1), (F.col("l_linenumber") == 1, None)], 0).alias("gibberish"),
    ).withColumn("flatline", rc.flatline(F.col("keep"), [F.col("a1"), F.col("a2"), F.col("a3")], ["Phishing", "Legitimate"]))


@query("P13_flatline", f"WITH {QUIZ} SELECT l_orderkey, l_partkey, l_linenumber, flatline FROM flat")
def _(t):
    return quiz(t).select("l_orderkey", "l_partkey", "l_linenumber", "flatline")


@query("P14_strange", f"""
WITH {QUIZ} SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN s THEN 1 WHEN NOT s THEN 0 END AS strange
FROM (SELECT *, keep AND (gibberish IS NOT DISTINCT FROM 1 OR flatline = 1) AS s FROM flat)""")
def _(t):
    return quiz(t).select("l_orderkey", "l_partkey", "l_linenumber", rc.strange(F.col("keep"), F.col("gibberish"), F.col("flatline")).alias("strange"))


@query("P15_cast_by_name", """
SELECT doc_id, TRY_CAST(substr(source, 4) AS DOUBLE) AS time_source, TRY_CAST(lang AS DOUBLE) AS time_lang,
  TRY_CAST(n_chars AS VARCHAR) AS label_chars FROM documents""")
def _(t):
    raw = t.documents.select("doc_id", F.expr("substr(source, 4)").alias("time_source"), F.col("lang").alias("time_lang"), F.col("n_chars").alias("label_chars"))
    return rc.cast_by_pattern(raw, [("^time_", "double"), ("^label_", "string")])


@query("P16_ordered_levels", """
SELECT o_orderkey, NULLIF(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH'], o_orderpriority), 0)::BIGINT AS level,
  NULLIF(list_position(['3-MEDIUM', '5-LOW', '4-NOT SPECIFIED', '2-HIGH'], o_orderpriority), 0)::BIGINT AS level_from_medium FROM orders""")
def _(t):
    levels = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]
    priority = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", rc.level_index(priority, levels).alias("level"),
                           rc.level_index(priority, rc.relevel(levels, "3-MEDIUM")).alias("level_from_medium"))


@query("P17_device_class", """
SELECT event_id, CASE WHEN regexp_matches(os, 'Android|iP') THEN 1 WHEN regexp_matches(os, 'CrOS|Windows') OR os IN ('Macintosh', 'Ubuntu') THEN 0 END AS mobile
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'Android 10' WHEN 'click' THEN 'iPhone' WHEN 'signup' THEN 'Windows NT'
  WHEN 'purchase' THEN 'Ubuntu' ELSE 'Solaris' END AS os FROM events)""")
def _(t):
    systems = {"view": "Android 10", "click": "iPhone", "signup": "Windows NT", "purchase": "Ubuntu"}
    return t.events.select("event_id", rc.device_class(rc.lookup(F.col("event_type"), systems, F.lit("Solaris"))).alias("mobile"))


@query("P18_label_lookup", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'Page view' WHEN 'click' THEN 'Button click' ELSE event_type END AS label FROM events""")
def _(t):
    return t.events.select("event_id", rc.recode(F.col("event_type"), {"view": "Page view", "click": "Button click"}).alias("label"))


@query("P19_prefixed_ids", "SELECT 'cust_' || o_custkey AS customer_id, 'ord_' || o_orderkey AS order_id FROM orders")
def _(t):
    return t.orders.select(rc.prefixed_id("cust_", F.col("o_custkey")).alias("customer_id"), rc.prefixed_id("ord_", F.col("o_orderkey")).alias("order_id"))
