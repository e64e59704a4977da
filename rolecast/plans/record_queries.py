"""Queries over whole records and the rules that fill them: layouts, nested items, text sections, labels, work histories; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dictionaries as D
from ..functions import facets, parsing, text
from ..functions.skills import expand_skill, infer_skills
from ..operators import evaluate, maintain, nested, normalize, ranking, retagging, tags
from ..operators import skills as K
from ..sources import dumps, json_arrays, records
from ..storage import new_folder, staged
from . import engine
from .bindings import bind, case, quoted, read, spread, sql_any, sql_categories, with_ctes
from .text_queries import ORACLES as TEXT_SQL
from .text_queries import _first_case, _pay_sql, _skill_sql, _years_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return keep


def _sql(spark: SparkSession, sf_dir: str, table: str, select: str) -> DataFrame:
    """A projection of one table or binding, in words that DuckDB knows as well."""
    source = bind(spark, sf_dir, table) if table.startswith("fx_") else read(spark, sf_dir, table)
    return spark.sql(f"SELECT {select} FROM {{t}}", t=source)


_PH = ", ".join(f"'{p}'" for p in D.PLACEHOLDERS)


def _clean(c: str) -> str:
    s = rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"
    return f"CASE WHEN NOT ({c} IS NULL OR {s} = '' OR {s} IN ({_PH}) OR suffix({s}, ' pending') OR suffix({s}, ' pending.')) THEN trim({c}) END"


@query("first_values", with_ctes(["fx_messy"], f"SELECT id, coalesce({_clean('raw')}, {_clean('num')}) AS value FROM fx_messy"))
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark, sf_dir, "fx_messy").select("id", text.first_present(F.col("raw"), F.col("num")).alias("value"))


_FLAGS = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_totalprice > 1500 AS VARCHAR(9)) WHEN 1 THEN CAST(o_custkey % 3 AS VARCHAR(9)) WHEN 2 THEN concat(' ', o_orderstatus, ' ') WHEN 3 THEN CASE WHEN o_custkey % 4 = 0 THEN ' YES ' WHEN o_custkey % 4 = 1 THEN '否' WHEN o_custkey % 4 = 2 THEN 'n' END ELSE o_orderpriority END AS v FROM {t}"


@query("truth_values", f"SELECT id, CASE WHEN lower(trim(v)) IN ('true', 'yes', '1', 'y', '是') THEN true WHEN lower(trim(v)) IN ('false', 'no', '0', 'n', '否') THEN false END AS value FROM ({_FLAGS.replace('{t}', 'orders')})")
def truth_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of orders as they may be written: booleans, numbers, words in either case, what is neither."""
    return spark.sql(_FLAGS, t=read(spark, sf_dir, "orders")).select("id", text.truth(F.col("v")).alias("value"))


@query(
    "record_texts",
    with_ctes(["fx_text"], r"""SELECT job_id, concat(title, chr(10), summary, CASE WHEN lower(company) <> lower(title) THEN concat(chr(10), company) ELSE '' END) AS blob, concat(summary, chr(10), chr(10), needs) AS summary,
 CASE WHEN job_id % 2 = 0 THEN title ELSE concat(title, ' ', summary) END AS head, CASE WHEN job_id % 2 = 0 THEN concat('岗位职责：', summary) END AS description, job_id % 2 = 0 OR length(concat(title, ' ', summary)) >= 80 OR contains(title, '要求') AS described FROM fx_text"""),
)
def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    line = F.when(c("job_id") % 2 == 0, F.concat("title", F.lit("岗位职责："), "summary")).otherwise(F.concat("title", F.lit(" "), "summary"))
    parts = parsing.split_title(line)
    return bind(spark, sf_dir, "fx_text").select(
        "job_id", text.text_blob(c("title"), c("summary"), F.upper("title"), c("company"), F.lit(" ")).alias("blob"), parsing.compose_summary(c("summary"), c("needs"), c("title")).alias("summary"), parts["title"].alias("head"), parts["description"].alias("description"), parsing.looks_like_description(line).alias("described"),
    )


@query(
    "posting_ids",
    with_ctes(["fx_text"], r"""SELECT job_id, CASE job_id % 4 WHEN 0 THEN concat('e', job_id) WHEN 1 THEN concat('o', job_id) WHEN 2 THEN CAST(job_id AS VARCHAR) ELSE 'http://x.org/about' END AS id, substr(replace(replace(trim(concat(summary, needs)), chr(0), ' '), chr(65279), ' '), 1, 12) AS head FROM fx_text"""),
)
def posting_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = F.col, F.col("job_id") % 4
    url = F.when(n == 2, F.concat(F.lit("http://x.org/job/"), c("job_id").cast("string"), F.lit(".html"))).otherwise("http://x.org/about")
    explicit, other = F.when(n == 0, F.concat(F.lit(" e"), "job_id")).otherwise(" "), F.when(n == 1, F.concat(F.lit("o"), "job_id"))
    return bind(spark, sf_dir, "fx_text").select("job_id", parsing.job_id(explicit, other, url, c("summary")).alias("id"), parsing.clean_raw(F.concat(F.lit(" "), "summary", "needs"), 12).alias("head"))


#: Fixed values of the postings' texts, chosen by remainders of keys.
_DUTY_MARKS, _NEED_MARKS, _PLUS_MARKS = ("岗位职责", "工作内容", "你将参与", "关于我们", "职位职责"), ("任职要求", "岗位要求", "我们希望你", "其他要求"), ("福利待遇", "加分项", "另外", "优先条件")
_MAJORS = ("计算机、软件工程等相关专业优先，", "本科学历数学/统计学、电子类相关专业；", "2025届统招本科及以上 自动化专业优先；", "", "计算机，信息安全相关专业者优先，", "相关专业；", "通信工程专业，")
_TONGUES = ("英语六级，可作为工作语言；德语加分", "日语N2优先，英文文档阅读", "英语CET-4及以上，能够长期稳定地与海外的同事每天用电子邮件往来沟通，另外要求法语流利", "", "韩语或日语熟练；英语不限")
_BODY = f"""concat(company, '招聘 ', title, chr(10), {case("job_id", _DUTY_MARKS)}, '：1. 负责', title, '的日常开发；2、', summary, ' 以及维护；短；负责', title, '的日常开发。每周到岗四天以上 | 连续实习3个月以上；
 三、与', company, '的团队协作 - 定期出差到现场', chr(10), {case("job_id", _NEED_MARKS)}, '：', {case("job_id", _MAJORS)}, needs, '；', {case("job_id", _TONGUES)}, chr(10), {case("job_id", _PLUS_MARKS)}, '：', company, ' 提供免费午餐；前端/后端/测试；', part_name, ' 有餐补和班车；提供弹性工作时间')"""


def _sql_list(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def _once(f: str) -> str:
    """DuckDB: a list without repeats, whatever their case."""
    return f"list_filter({f}, lambda x, i: list_position(list_transform({f}, lambda y: lower(y)), lower(x)) = i)"


def _items(c: str) -> str:
    """DuckDB: items of a text, repeats among them."""
    lines = rf"regexp_replace({c}, '[\r•●▪■◆◇]|\s+(?:[-–—]|\|)\s+', chr(10), 'g')"
    lines = rf"regexp_replace({lines}, '(?:^|\n)\s*(?:\d+|[一二三四五六七八九十]+)[、.．:：)]\s*', chr(10), 'g')"
    lines = rf"regexp_replace(regexp_replace({lines}, '[；;]', chr(10), 'g'), '([。！？])\s*', '\1' || chr(10), 'g')"
    bare = rf"regexp_replace(trim(regexp_replace(x, '^[\-\d、.．:：()（）\s]+', '')), '^(?:{'|'.join(D.ITEM_HEADINGS)})[：:\s-]*', '')"
    parts = f"list_transform(string_split({lines}, chr(10)), lambda x: trim(regexp_replace({bare}, '^[，,。；; ]+|[，,。；; ]+$', '', 'g')))"
    return f"list_filter({parts}, lambda x: length(x) >= 6 AND NOT {sql_any('x', D.RESPONSIBILITY_MARKERS + D.SECTION_ENDS)})"


def _parts(markers, most: int) -> str:
    """DuckDB: the items of the parts behind each marker of ``body``, by marker."""
    tails = rf"list_transform({_sql_list(markers)}, lambda m: CASE WHEN strpos(body, m) > 0 THEN regexp_replace(substr(body, strpos(body, m) + length(m)), '^[：:\-\s]+', '') ELSE '' END)"
    stop = f"list_min(list_filter(list_transform({_sql_list(D.SECTION_ENDS)}, lambda e: strpos(t, e)), lambda p: p > 0))"
    cuts = f"list_transform({tails}, lambda t: trim(CASE WHEN {stop} IS NOT NULL THEN substr(t, 1, {stop} - 1) ELSE t END, ' ' || chr(10)))"
    return f"list_transform(list_transform({cuts}, lambda c: {_items('c')}), lambda f: ({_once('f')})[1:{most}])"


def _shine(list_sql: str) -> str:
    """DuckDB: what of the items may be shown."""
    s = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(x, '^(?:项|加分项|福利待遇|优选条件|优先条件)[?:\s-]*', '')), '^(?:\d+|\?+)[)?.:]\s*', ''), '^[?: ]+', ''), '^[?,; ]+|[?,; ]+$', '', 'g'), '^[^A-Za-z0-9一-龥]+', '')"
    return f"list_filter(list_transform({list_sql}, lambda x: {s}), lambda x: x <> '' AND NOT regexp_full_match(x, '[A-Za-z一-龥]+(?:/[A-Za-z一-龥]+)+'))"


@query(
    "posting_sections",
    with_ctes(["fx_text"], f"""SELECT job_id, duties, CAST(n AS INT) AS n_items, array_to_string(({_once("h")})[1:6], '|') AS highlights FROM
 (SELECT job_id, array_to_string(coalesce(d, []), '|') AS duties, len(coalesce(d, [])) AS n, CASE WHEN len(named) > 0 THEN named ELSE spread END AS h FROM
 (SELECT job_id, list_filter({_parts(D.RESPONSIBILITY_MARKERS, 8)}, lambda x: len(x) > 0)[1] AS d, {_shine(f"flatten({_parts(D.HIGHLIGHT_MARKERS, 4)})")} AS named,
 list_filter({_shine(_items("body"))}, lambda x: NOT {sql_any("x", D.RESPONSIBILITY_MARKERS + D.EDUCATION_WORDS)} AND {sql_any("x", D.HIGHLIGHT_KEYWORDS)}) AS spread FROM (SELECT job_id, {_BODY} AS body FROM fx_text)))"""),
)
def posting_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the work is and what is offered, out of postings whose parts begin and end with differing words."""
    rows = _sql(spark, sf_dir, "fx_text", f"job_id, {_BODY} AS body").select("job_id", parsing.responsibilities(F.col("body")).alias("duties"), parsing.highlights(F.col("body")).alias("plus"))
    return rows.select("job_id", F.array_join("duties", "|").alias("duties"), F.size("duties").alias("n_items"), F.array_join("plus", "|").alias("highlights"))


def _majors(preferred: bool) -> str:
    """DuckDB: fields of study before the words that ask for one."""
    find = [rf"'(?i)([一-龥A-Za-z/、，,\s]{{2,80}}?)(?:等)?{tail}'" for tail in ("相关专业(?:优先|者优先)?", "专业(?:优先|者优先)")]
    pairs = "list_concat(" + ", ".join(f"list_zip(regexp_extract_all(body, {p}, 0), regexp_extract_all(body, {p}, 1))" for p in find) + ")"
    kind = f"list_filter({pairs}, lambda p: contains(p[1], '优先') = {preferred})"
    names = rf"list_transform({kind}, lambda p: regexp_replace(regexp_replace(p[2], '.*学历', '', 'g'), '\d{{4}}届|海内外|统招|学历|及以上|或研究生|或以上|以上', '', 'g'))"
    tokens = rf"list_transform(flatten(list_transform({names}, lambda n: string_split_regex(n, '[、,/，]\s*|\s+'))), lambda t: trim(regexp_replace(regexp_replace(trim(t), '(相关专业|相关)$', ''), '(专业|类)$', '')))"
    return f"list_filter({tokens}, lambda t: length(t) >= 2 AND t NOT IN ({', '.join(quoted(w) for w in D.MAJOR_STOPWORDS)}))"


def _level(around: str) -> str:
    sets = (("fluent", ("流利", "熟练", "可作为工作语言", "business")), ("advanced", ("cet-6", "cet6", "六级", "n1")), ("intermediate", ("cet-4", "cet4", "四级", "n2")))
    return "CASE " + " ".join(f"WHEN {sql_any(f'lower({around})', w)} THEN '{n}'" for n, w in sets) + " END"


def _tongues() -> str:
    """DuckDB: each language by the first of its words that occurs."""
    each = []
    for name, words in D.LANGUAGE_PATTERNS.items():
        places = "[" + ", ".join(f"{{'p': strpos(lower(body), '{w}'), 'n': {len(w)}}}" for w in words) + "]"
        each.append(f"list_transform(list_filter({places}, lambda x: x.p > 0)[1:1], lambda x: {{'name': '{name}', 'around': substr(body, greatest(1, x.p - 24), x.p - greatest(1, x.p - 24) + x.n + 24)}})")
    return f"list_transform(list_concat({', '.join(each)}), lambda x: concat_ws(':', x.name, coalesce({_level('x.around')}, '-'), CASE WHEN contains(x.around, '优先') OR contains(x.around, '加分') THEN 'false' ELSE 'true' END))"


@query(
    "education_fields",
    with_ctes(["fx_text"], f"""SELECT job_id, array_to_string({_once("required")}, ',') AS required_majors, array_to_string({_once("preferred")}, ',') AS preferred_majors, array_to_string(tongues, ',') AS languages, array_to_string(({_once("other")})[1:6], '|') AS other FROM
 (SELECT job_id, {_majors(False)} AS required, {_majors(True)} AS preferred, {_tongues()} AS tongues, list_filter({_items("body")}, lambda x: {sql_any("x", D.OTHER_CONSTRAINT_WORDS)}) AS other FROM (SELECT job_id, {_BODY} AS body FROM fx_text))"""),
)
def education_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of study, languages with level and need, and other constraints of whole postings."""
    rows = _sql(spark, sf_dir, "fx_text", f"job_id, {_BODY} AS body").select("job_id", parsing.education_constraints(F.col("body")).alias("e"))
    tongues = F.transform("e.languages", lambda x: F.concat_ws(":", x["language"], F.coalesce(x["level"], F.lit("-")), x["required"].cast("string")))
    return rows.select("job_id", F.array_join("e.required_majors", ",").alias("required_majors"), F.array_join("e.preferred_majors", ",").alias("preferred_majors"), F.array_join(tongues, ",").alias("languages"), F.array_join("e.other", "|").alias("other"))


def _places(source: str, key: str, column: str, pattern: str, reach: int) -> str:
    """DuckDB: matches with their places by sums over rows, and what is around them."""
    return f"""SELECT {key}, CAST(place AS INT) AS place, hit, substr({column}, greatest(1, place - {reach}), place - greatest(1, place - {reach}) + length(hit) + {reach}) AS around FROM
 (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY {key} ORDER BY i)::BIGINT - length(hit) + 1 AS place FROM
 (SELECT {key}, {column}, unnest(string_split_regex({column}, '{pattern}')[1:len(h)]) AS gap, unnest(h) AS hit, unnest(range(1, len(h) + 1)) AS i FROM (SELECT *, regexp_extract_all({column}, '{pattern}') AS h FROM {source})))"""


_TONGUE_WORDS = {w: n for n, ws in D.LANGUAGE_PATTERNS.items() for w in ws}


@query(
    "language_mentions",
    with_ctes(["fx_text"], f"""SELECT job_id, place, hit, around, CASE {" ".join(f"WHEN lower(hit) = '{w}' THEN '{n}'" for w, n in _TONGUE_WORDS.items())} END AS language, {_level("around")} AS level, NOT (contains(around, '优先') OR contains(around, '加分')) AS required FROM
 ({_places(f"(SELECT job_id, {_BODY} AS body FROM fx_text)", "job_id", "body", "(?i)" + "|".join(_TONGUE_WORDS), 24)})"""),
)
def language_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of a language in postings, with its place, level and need."""
    rows = _sql(spark, sf_dir, "fx_text", f"job_id, {_BODY} AS body").select("job_id", F.explode(parsing.language_mentions(F.col("body"))).alias("m"))
    return rows.select("job_id", F.col("m.at").alias("place"), "m.hit", "m.around", "m.language", "m.level", "m.required")


@query("document_mentions", _places("(SELECT doc_id, text FROM documents)", "doc_id", "text", "(?i)data|model|search|river|copyright", 16))
def document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of some words in whole documents, with sixteen characters on either side."""
    hits = text.occurrences(F.col("text"), "(?i:data|model|search|river|copyright)", 16)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(hits).alias("m"))
    return rows.select("doc_id", F.col("m.at").alias("place"), "m.hit", F.concat("m.left", "m.hit", "m.right").alias("around"))


@query(
    "skill_names",
    with_ctes(["fx_text"], """SELECT job_id, concat_ws(',', a, CASE WHEN b <> a THEN b END) AS parts, concat_ws(',', a, CASE WHEN b <> a THEN b END, lower(company)) AS terms, concat_ws(',', a, CASE WHEN b <> a THEN b END, company) AS topics, CASE WHEN contains(summary, a) THEN 1 ELSE 0 END + CASE WHEN contains(summary, 'redis') THEN 1 ELSE 0 END AS hits
 FROM (SELECT *, split_part(part_name, ' ', 1) AS a, split_part(part_name, ' ', 2) AS b FROM fx_text)"""),
)
def skill_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, words = F.col, F.split("part_name", " ")
    show = lambda a: F.array_join(a, ",")
    return bind(spark, sf_dir, "fx_text").select(
        "job_id", show(expand_skill(F.concat(words[0], F.lit("/"), words[1]))).alias("parts"), show(K.terms(F.concat(words, F.array(F.upper(words[0]), F.lit("skill pending"), c("company"))))).alias("terms"),
        show(K.topics(words, F.array(F.upper(words[1])), F.array("company"))).alias("topics"), text.fuzzy_hits(F.array(words[0], F.lit("redis"), F.lit("x")), c("summary")).alias("hits"),
    )


@query(
    "inferred_skills",
    with_ctes(["fx_text"], f"""SELECT job_id, array_to_string({_once("every")}, ',') AS skills FROM (SELECT job_id, list_filter(list_transform(list_concat([part_name], string_split_regex(needs, '[、，,/ ]+'), string_split(found, ',')), lambda x: trim(x)), lambda x: x <> '') AS every FROM
 (SELECT *, {_skill_sql("t")} AS found FROM (SELECT *, concat(summary, chr(10), needs) AS t FROM fx_text)))"""),
)
def inferred_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parts first, then words of the requirements, then the skills that texts hold, some of them named before."""
    named = [F.array("part_name"), F.split("needs", "[、，,/ ]+")]
    return bind(spark, sf_dir, "fx_text").select("job_id", F.array_join(infer_skills(named, F.concat_ws("\n", "summary", "needs")), ",").alias("skills"))


def _tagged(kind: str, values: str) -> str:
    return f"list_transform(list_filter(string_split({values}, ','), lambda x: x <> ''), lambda x: concat('{kind}:', x))"


_PERSON = "lower(concat_ws(' ', title, summary))"


@query(
    "person_tags",
    with_ctes(["fx_people"], f"""SELECT p.resume_id, array_to_string(list_concat({_tagged("role", "f.roles")}, {_tagged("city", "c.cities")}, {_tagged("work_mode", "f.modes")}, {_tagged("ai_capability", "p.ai")}, {_tagged("seniority", "f.seniority")},
 CASE WHEN f.salary_min IS NOT NULL THEN [concat('salary_band:salary:', f.salary_min, '-', f.salary_max)] ELSE [] END), ',') AS tags, CASE WHEN p.resume_id % 3 = 0 THEN p.title ELSE f.roles END AS facet FROM
 (SELECT *, {sql_categories(_PERSON, D.AI_KEYWORDS)} AS ai FROM fx_people) p JOIN ({TEXT_SQL["people_facets"]}) f ON p.resume_id = f.resume_id JOIN ({TEXT_SQL["people_cities"]}) c ON p.resume_id = c.resume_id"""),
)
def person_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard tags of people by what their records say; of every third the roles stand in stored tags."""
    c = F.col
    rows = bind(spark, sf_dir, "fx_people").withColumns({"roles": facets.role_categories(c("title"), c("summary")), "level": facets.resume_seniority(c("title"), c("summary"), c("years"))})
    pay = facets.inferred_salary(c("years"), c("level"), c("roles"), c("city"), c("raw_text"))
    made = tags.resume_tags(c("roles"), facets.target_cities(c("city"), c("raw_text")), facets.resume_work_modes(c("raw_text")), facets.ai_capabilities(c("title"), c("summary")), c("level"), pay)
    stored = F.when(c("resume_id") % 3 == 0, tags.facet_tags(F.array("title"), "role", "role_categories"))
    return rows.select("resume_id", F.array_join(F.transform(made, lambda t: F.concat_ws(":", t["category"], t["name"])), ",").alias("tags"), F.array_join(tags.facet_values(stored, "role_categories", c("roles")), ",").alias("facet"))


def _real(c: str) -> str:
    """DuckDB: the text unless it is blank or a stand-in."""
    return f"CASE WHEN trim({c}) <> '' AND lower(trim({c})) NOT IN ({_PH}) THEN {c} END"


def _short(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN concat(substr({c}, 1, {n - 1}), '…') ELSE {c} END"


_WORK = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN concat('Engineer ', o_custkey) WHEN 1 THEN 'Role Pending' ELSE ' ' END AS title, CASE o_orderkey % 4 WHEN 0 THEN concat('C', o_custkey) WHEN 1 THEN 'company pending' END AS company_name,
 CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority END AS industry, CASE o_orderkey % 7 WHEN 0 THEN o_orderstatus END AS location, CASE o_orderkey % 2 WHEN 0 THEN 'L2' END AS level,
 CASE o_orderkey % 11 WHEN 0 THEN 'Vue' WHEN 1 THEN 'MySQL' WHEN 2 THEN 'flutter' WHEN 3 THEN 'uniapp' WHEN 4 THEN 'C++' END AS tech, CASE o_orderkey % 13 WHEN 0 THEN concat('负责前端页面与 ', o_orderpriority, ' 的小程序交付以及长期维护和文档编写工作') WHEN 1 THEN '编写接口' WHEN 2 THEN concat('审计 ', o_orderpriority, ' 的账目并整理成为每个季度的报告和说明文件') WHEN 3 THEN 'skill pending' END AS item,
 CASE o_orderkey % 6 WHEN 0 THEN '移动端上线' END AS won FROM {t}"""
_DOES = {k: "(" + f"coalesce(lower({_real('tech')}) IN ({', '.join(quoted(w) for w in D.STACKS[k])}), false) OR " + sql_any("told", D.STACK_WORDS[k]) + ")" for k in D.STACKS}


@query(
    "work_labels",
    f"""SELECT id, coalesce({_real("title")}, {_real("company_name")}, CASE WHEN {" + ".join(f"CAST({d} AS INT)" for d in _DOES.values())} > 1 THEN '全栈开发经历' {" ".join(f"WHEN {d} THEN '{k}开发经历'" for k, d in _DOES.items())} END, {_short("first", 24)}, '开发经历') AS headline,
 coalesce(CASE WHEN ({_real("title")}) IS NOT NULL THEN {_real("company_name")} ELSE {_real("industry")} END, {_real("location")}, {_real("level")}) AS meta, coalesce({_short("coalesce(first, won)", 80)}, CASE WHEN tech IS NOT NULL THEN concat('技术栈：', tech) END) AS note FROM
 (SELECT *, {_real("item")} AS first, lower(concat_ws(' ', {_real("item")}, won)) AS told FROM ({_WORK.replace("{t}", "orders")}))""",
)
def work_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline, line below it and note of pieces of work, whose fields are there, missing or stand-ins."""
    c = F.col
    rows = spark.sql(_WORK, t=read(spark, sf_dir, "orders"))
    work = F.struct("title", "company_name", "industry", "location", "level", F.array("tech").alias("tech_stack"), F.array("item").alias("responsibilities"), F.array("won").alias("achievements"))
    rows = rows.select("id", work.alias("w"))
    return rows.select("id", normalize.experience_headline(c("w")).alias("headline"), normalize.experience_meta(c("w")).alias("meta"), normalize.experience_note(c("w")).alias("note"))


_OFFER = """SELECT p_partkey AS job_id, p_partkey % 7 = 0 AS salary_negotiable, CASE WHEN p_partkey % 3 > 0 THEN 6000 + (p_partkey % 200) * 100 END AS salary_min, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 6000 + (p_partkey % 200) * 100 ELSE 9000 + (p_partkey % 200) * 130 END AS salary_max,
 CASE WHEN p_size % 5 = 0 THEN 'USD' WHEN p_size % 5 = 1 THEN ' ' END AS currency, CASE WHEN p_size % 4 = 0 THEN p_size * 10 END AS intern_salary_amount, CASE WHEN p_size % 8 = 0 THEN '元/天' END AS intern_salary_unit, CASE WHEN p_size % 3 = 0 THEN 12 END AS salary_months_min, CASE WHEN p_size % 6 = 0 THEN 14 END AS salary_months_max,
 CASE WHEN p_size % 2 = 0 THEN CAST('2024-01-05 10:00:00' AS TIMESTAMP) END AS posted_at, CASE WHEN p_size % 3 = 0 THEN p_size END AS days FROM {t}"""


def _span(a: str, b: str, unit: str) -> str:
    return f"CASE WHEN {a} <> {b} THEN concat({a}, '-', {b}, {unit}) ELSE concat(coalesce({a}, {b}), CASE WHEN coalesce({a}, {b}) IS NOT NULL THEN {unit} END) END"


@query(
    "labels_shown",
    f"""SELECT job_id, CASE WHEN salary_negotiable THEN '薪资面议' ELSE coalesce(nullif(concat_ws(' / ', coalesce(nullif(pay, ''), nullif(intern, '')), nullif(months, '')), ''), '暂无薪资信息') END AS pay,
 CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN {_span("salary_min", "salary_max", "' 元/月'")} WHEN salary_min IS NOT NULL THEN concat(salary_min, ' 元/月起') WHEN salary_max IS NOT NULL THEN concat(salary_max, ' 元/月以内') ELSE '未注明' END AS wanted,
 CASE WHEN posted_at IS NOT NULL THEN strftime(posted_at, '%Y-%m-%d') WHEN days IS NOT NULL THEN concat(days, ' 天前') ELSE '未注明' END AS posted FROM
 (SELECT *, {_span("salary_min", "salary_max", "concat(' ', coalesce(nullif(trim(currency), ''), 'CNY'))")} AS pay, concat(intern_salary_amount, CASE WHEN intern_salary_amount IS NOT NULL AND intern_salary_unit IS NOT NULL THEN concat(' ', intern_salary_unit) END) AS intern, {_span("salary_months_min", "salary_months_max", "' 薪'")} AS months FROM ({_OFFER.replace("{t}", "part")}))""",
)
def labels_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay, wanted pay and date of posting as people read them."""
    c = F.col
    rows = spark.sql(_OFFER, t=read(spark, sf_dir, "part"))
    info = F.struct("salary_negotiable", "salary_min", "salary_max", "currency", "intern_salary_amount", "intern_salary_unit", "salary_months_min", "salary_months_max")
    rows = rows.select("job_id", info.alias("i"), "salary_min", "salary_max", "posted_at", "days")
    return rows.select("job_id", normalize.salary_label(c("i")).alias("pay"), normalize.monthly_label(c("salary_min"), c("salary_max")).alias("wanted"), normalize.posted_label(c("posted_at"), c("days")).alias("posted"))


@query(
    "json_fields",
    with_ctes(["fx_text"], """SELECT job_id, CASE job_id % 3 WHEN 0 THEN concat_ws(',', title, company) WHEN 1 THEN title ELSE '' END AS list, CASE WHEN job_id % 2 = 0 THEN concat(title, chr(10), company, chr(10), part_name) ELSE title END AS description FROM fx_text"""),
)
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = F.col, F.col("job_id") % 3
    listed = F.when(n == 0, F.to_json(F.array("title", "company"))).when(n == 1, c("title")).otherwise(" ")
    raw = F.when(c("job_id") % 2 == 0, F.to_json(F.struct(c("company").alias("infos"), c("title").alias("requirements"), c("part_name").alias("text")))).otherwise(F.concat(F.lit(" "), "title"))
    return bind(spark, sf_dir, "fx_text").select("job_id", F.array_join(text.json_string_list(listed), ",").alias("list"), parsing.description_text(raw).alias("description"))


@query(
    "board_records",
    with_ctes(["fx_text"], """SELECT concat('p', job_id) AS id, CASE job_id % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'board_a' WHEN 2 THEN 'board_b' ELSE 'other' END AS dialect, CASE WHEN job_id % 4 < 3 THEN title END AS title, CASE WHEN job_id % 4 = 1 THEN NULL ELSE company END AS company,
 CASE job_id % 4 WHEN 1 THEN location WHEN 0 THEN location WHEN 2 THEN '上海' END AS location, CASE job_id % 4 WHEN 0 THEN summary WHEN 3 THEN NULL ELSE concat(summary, ' ', needs) END AS text, CASE WHEN job_id % 4 = 2 THEN 'retail,ai' ELSE '' END AS industry FROM fx_text"""),
)
def board_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layouts of openings through the one mapping."""
    c, n = F.col, F.col("job_id") % 4
    board = F.when((n == 1) | (n == 2), F.concat("summary", F.lit(" "), "needs"))
    given = {
        "id": F.concat(F.lit("p"), "job_id"), "title": F.when(n == 0, c("title")), "job_name": F.when((n == 1) | (n == 2), c("title")), "jd": board, "summary": F.when(n == 0, c("summary")), "skill_tags": F.when(n == 1, F.to_json(F.array(F.lit("java")))),
        "job_keys": F.when(n == 2, F.lit("java,团队")), "company": F.when(n != 1, c("company")), "location": F.when(n == 0, c("location")), "work_address": F.when(n == 1, c("location")), "city": F.when(n == 2, F.lit("上海")), "company_industry": F.when(n == 2, F.lit("retail/ai")),
    }
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], records.RAW).schema.fields}
    raw = bind(spark, sf_dir, "fx_text").select(*[given.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in kinds.items()])
    return records.map_boards(raw).select("id", "dialect", "title", "company", "location", "text", F.array_join("industry", ",").alias("industry"))


@query(
    "clean_openings",
    with_ctes(["fx_text"], """SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'Untitled Role' ELSE title END AS title, concat_ws(',', CASE WHEN job_id % 3 > 0 THEN company END, 'Go') AS required, CASE WHEN job_id % 4 = 0 THEN '' ELSE concat(CASE WHEN job_id % 2 = 0 THEN 'Optional Skills' ELSE part_name END, ':1:Vue') END AS groups,
 concat_ws(',', CASE WHEN job_id % 3 = 1 THEN concat('project:', title) END, concat('tech:', part_name)) AS core, CASE WHEN job_id % 3 = 0 THEN '' ELSE 'English:false' END AS languages, '' AS majors, CASE WHEN job_id % 6 = 0 THEN '' ELSE company END AS tags FROM fx_text"""),
)
def clean_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings whose lists name nothing here and there."""
    c, n = F.col, F.col("job_id")
    given = F.struct(
        n.cast("string").alias("id"),
        F.struct(F.when(n % 5 > 0, c("title")).otherwise("").alias("title")).alias("basic_info"),
        F.struct(
            F.array(F.struct(F.when(n % 3 > 0, F.concat(F.lit(" "), "company")).otherwise("skill pending").alias("name")), F.struct(F.lit("Go").alias("name"))).alias("required"),
            F.array(F.struct(F.when(n % 2 > 0, c("part_name")).alias("group_name"), F.array(F.struct(F.when(n % 4 > 0, "Vue").otherwise(" ").alias("name"))).alias("skills"))).alias("optional_groups"),
        ).alias("skill_requirements"),
        F.struct(F.array(F.struct(F.when(n % 3 == 1, c("title")).alias("name"), F.lit("").alias("type")), F.struct(c("part_name").alias("name"), F.lit("tech").alias("type"))).alias("core")).alias("experience_requirements"),
        F.struct(F.array(F.struct(F.when(n % 3 > 0, "English").alias("language"))).alias("languages")).alias("education_constraints"),
        F.array(F.struct(F.when(n % 6 > 0, c("company")).otherwise("").alias("name"))).alias("tags"),
    )
    typed = bind(spark, sf_dir, "fx_text").select("job_id", F.from_json(F.to_json(given), schemas.JOB).alias("r")).select("job_id", "r.*")
    show = lambda a, *fields: F.array_join(F.transform(a, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ",")
    groups = F.array_join(F.transform("skill_requirements.optional_groups", lambda g: F.concat_ws(":", g["group_name"], g["min_required"].cast("string"), F.array_join(F.transform(g["skills"], lambda s: s["name"]), "+"))), ",")
    return nested.clean_openings(typed).select(
        "job_id", c("basic_info.title").alias("title"), show(c("skill_requirements.required"), "name").alias("required"), groups.alias("groups"), show(c("experience_requirements.core"), "type", "name").alias("core"),
        show(c("education_constraints.languages"), "language", "required").alias("languages"), F.array_join("education_constraints.required_majors", ",").alias("majors"), show(c("tags"), "name").alias("tags"),
    )


_JOB_RANK = "CAST(row_number() OVER (PARTITION BY resume_id ORDER BY vector DESC, job_id) AS INT)"


@query(
    "external_agreement",
    with_ctes(["fx_pairs"], f"""WITH a AS (SELECT resume_id, job_id, {_JOB_RANK} AS rank FROM fx_pairs), e AS (SELECT resume_id, job_id, row_number() OVER (PARTITION BY resume_id ORDER BY score DESC, job_id) AS rank FROM (SELECT o_custkey AS resume_id, l_partkey AS job_id, max(l_quantity) AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber <> 2 GROUP BY ALL)),
 b AS (SELECT a.resume_id, row_number() OVER (PARTITION BY a.resume_id ORDER BY a.rank, a.job_id) AS ra, row_number() OVER (PARTITION BY a.resume_id ORDER BY e.rank, a.job_id) AS rb FROM a JOIN e ON a.resume_id = e.resume_id AND a.job_id = e.job_id)
 SELECT resume_id, count(*) AS n, CASE WHEN count(*) <= 1 THEN 1.0E0 ELSE round(1 - 6.0E0 * sum((ra - rb) * (ra - rb)) / (count(*) * (count(*) * count(*) - 1)), 6) END AS rho FROM b GROUP BY resume_id"""),
)
def external_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External scores joined to the algorithm's ranks by job, and how far the two agree."""
    z = F.lit(0.0)
    mine = ranking.rank_algorithm(bind(spark, sf_dir, "fx_pairs").withColumn("total", F.col("vector")))
    given = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem").filter("l_linenumber <> 2"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("resume_id"), F.col("l_partkey").alias("job_id")).agg(F.max("l_quantity").alias("score"))
    external = ranking.rank_external(given.withColumns({n: z for n in ("domain", "skill", "experience", "location", "education", "salary", "transition_cost")}))
    return evaluate.spearman(evaluate.against_algorithm(mine, external)).select("resume_id", "n", "rho")


_HISTORY = """concat('工作经历', chr(10), 2010 + resume_id % 9, '.3-', 2012 + resume_id % 9, '.05 星辰科技有限公司 Java工程师', chr(10), CASE WHEN resume_id % 2 = 0 THEN concat(2013 + resume_id % 9, '年06-至今 AcmeInc 架构师') ELSE '教育经历' END)"""


#: Raw postings as JSON: some fields are there for some keys only.
_RAW = f"""SELECT *, {_BODY} AS body, CASE WHEN job_id % 3 > 0 THEN pay END AS salary, CASE WHEN job_id % 2 = 0 THEN location END AS place, CASE WHEN job_id % 4 = 0 THEN '研发部' WHEN job_id % 4 = 1 THEN ' ' END AS department,
 CASE WHEN job_id % 5 = 0 THEN 9000 END AS floor, CASE WHEN job_id % 6 = 0 THEN 'bachelor' END AS degree, CASE WHEN job_id % 3 = 1 THEN 'retail/ai' END AS trade FROM {{t}}"""
_RAW_SQL = _RAW.replace("{t}", "fx_text")


def _fill_sql() -> str:
    """DuckDB: which of the 26 paths a raw posting has and which its normalised record has, counted by path."""
    skills = _skill_sql("t")
    n_skills = "len(list_filter(string_split(skills, ','), lambda x: x <> ''))"
    has = lambda f: f"len({f}) > 0"
    duties, shines = f"len(list_filter({_parts(D.RESPONSIBILITY_MARKERS, 8)}, lambda x: len(x) > 0)) > 0", _shine(f"flatten({_parts(D.HIGHLIGHT_MARKERS, 4)})")
    spread = f"list_filter({_shine(_items('body'))}, lambda x: NOT {sql_any('x', D.RESPONSIBILITY_MARKERS + D.EDUCATION_WORDS)} AND {sql_any('x', D.HIGHLIGHT_KEYWORDS)})"
    first = lambda pairs: _first_case("body", pairs, True) + " IS NOT NULL"
    words = lambda d: " OR ".join(sql_any("lower(body)", [w.lower() for w in ws]) for ws in d)
    rules = {
        "department": ("coalesce(trim(department), '') <> ''", "false"), "location": ("place IS NOT NULL", "place IS NOT NULL"), "job_type": ("false", sql_any("lower(concat_ws(' ', title, body))", D.INTERN_KEYWORDS)),
        "salary_negotiable": ("false", "lo IS NOT NULL OR talk"), "salary_min": ("floor IS NOT NULL", "lo IS NOT NULL"), "salary_max": ("false", "hi IS NOT NULL"), "salary_months_min": ("false", "m1 IS NOT NULL"), "salary_months_max": ("false", "m2 IS NOT NULL"),
        "intern_salary_amount": ("false", "false"), "intern_salary_unit": ("false", "false"), "responsibilities": ("false", duties), "highlights": ("false", f"{has(shines)} OR {has(spread)}"),
        "required": ("false", f"{n_skills} > 0"), "bonus": ("false", f"{n_skills} > 3"), "core": ("false", "trade IS NOT NULL"), "min_total_years": ("false", "post_min IS NOT NULL"), "max_total_years": ("false", "post_max IS NOT NULL"),
        "min_degree": ("degree IS NOT NULL", f"{_first_case('body', D.DEGREE_WORDS, False)} IS NOT NULL OR {first([(p, n) for n, p in D.MIN_DEGREE_PATTERNS.items()])}"), "prefer_degrees": ("false", first([(p, n) for n, p in D.PREFER_DEGREE_PATTERNS.items()])),
        "required_majors": ("false", has(_majors(False))), "preferred_majors": ("false", has(_majors(True))), "languages": ("false", words(D.LANGUAGE_PATTERNS.values())), "certifications": ("false", words([D.CERTIFICATIONS])),
        "age_range": ("false", rf"regexp_matches(body, '\d{{2}}\s*[-~～至到]\s*\d{{2}}\s*岁|\d{{2}}\s*岁(以下|以内|以上|及以上)')"), "other": ("false", has(f"list_filter({_items('body')}, lambda x: {sql_any('x', D.OTHER_CONSTRAINT_WORDS)})")), "tags": ("false", "true"),
    }
    paths = {p.rsplit(".", 1)[-1]: p for _, p in evaluate.FILL_PATHS}
    pay = _pay_sql(False).replace("FROM fx_text", f"FROM (SELECT job_id, coalesce(salary, body) AS pay FROM ({_RAW_SQL}))")
    base = f"""SELECT *, {skills} AS skills FROM (SELECT r.*, concat(r.title, chr(10), r.body) AS t, p.* EXCLUDE (job_id), y.post_min, y.post_max FROM ({_RAW_SQL}) r JOIN ({pay}) p ON r.job_id = p.job_id JOIN ({_years_sql()}) y ON r.job_id = y.job_id)"""
    each = ", ".join(f"{{'field': '{paths[n]}', 'a': coalesce({a}, false), 'b': coalesce({b}, false)}}" for n, (a, b) in rules.items())
    return f"SELECT x.field AS field, count(*) FILTER (NOT x.a AND x.b) AS filled, count(*) FILTER (x.a AND x.b) AS kept, count(*) FILTER (x.a AND NOT x.b) AS lost FROM (SELECT unnest([{each}]) AS x FROM ({base})) GROUP BY 1"


@query("normalization_fill", with_ctes(["fx_text"], _fill_sql()))
def normalization_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often normalisation fills each of the 26 paths of a posting that its raw JSON leaves empty, keeps or loses it."""
    c = F.col
    rows = spark.sql(_RAW, t=bind(spark, sf_dir, "fx_text"))
    payload = F.to_json(F.struct(
        F.concat(F.lit("p"), "job_id").alias("id"), "title", "company", "department", c("place").alias("location"), c("body").alias("description"), "salary", c("needs").alias("experience"), c("trade").alias("company_industry"),
        F.when(c("floor").isNotNull(), F.struct(c("floor").alias("salary_min"))).alias("basic_info"), F.when(c("degree").isNotNull(), F.struct(c("degree").alias("min_degree"), text.strings().alias("languages"))).alias("education_constraints"), text.strings().alias("tags"),
    ))
    raw = rows.select(F.concat(F.lit("p"), "job_id").alias("id"), payload.alias("payload"))
    typed = raw.select(F.from_json("payload", f"struct<{records.RAW}>").alias("r")).select("r.*")
    return evaluate.job_fill_report(raw, normalize.normalize_jobs(records.map_boards(typed), F.to_date(F.lit("2024-01-31"))))


@query(
    "work_histories",
    with_ctes(["fx_people"], """SELECT resume_id, concat_ws('|', CASE WHEN resume_id % 2 = 0 THEN concat('AcmeInc/架构师/', 2013 + resume_id % 9, '.06/至今') END, concat('星辰科技有限公司/Java工程师/', 2010 + resume_id % 9, '.03/', 2012 + resume_id % 9, '.05'), CASE WHEN resume_id % 3 = 0 THEN concat('旧公司/测试/2001.01/2002.01') END) AS history,
 CASE WHEN resume_id % 4 = 0 THEN 7 WHEN resume_id % 2 = 0 THEN greatest(1, CAST(round_even((2024 * 12 + 1 - ((CASE WHEN resume_id % 3 = 0 THEN 2001 ELSE 2010 + resume_id % 9 END) * 12 + CASE WHEN resume_id % 3 = 0 THEN 1 ELSE 3 END)) / 12.0E0, 0) AS INT))
 ELSE greatest(1, CAST(round_even(((2012 + resume_id % 9) * 12 + 5 - ((CASE WHEN resume_id % 3 = 0 THEN 2001 ELSE 2010 + resume_id % 9 END) * 12 + CASE WHEN resume_id % 3 = 0 THEN 1 ELSE 3 END)) / 12.0E0, 0) AS INT)) END AS years FROM fx_people"""),
)
def work_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work read from text, merged with what is stored, and the years that follow from it."""
    as_of, c = F.to_date(F.lit("2024-01-31")), F.col
    people = _sql(spark, sf_dir, "fx_people", f"resume_id AS id, {_HISTORY.replace('chr(10)', 'char(10)')} AS raw_text")
    none = text.none_of("string")
    stored = people.select(
        "id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("星辰科技有限公司").alias("company_name"), none.alias("title"), F.concat((2010 + c("id") % 9).cast("string"), F.lit(".03")).alias("start_date"), F.concat((2012 + c("id") % 9).cast("string"), F.lit(".05")).alias("end_date")), F.struct(F.lit(1).alias("pos"), F.lit("旧公司").alias("company_name"), F.lit("测试").alias("title"), F.lit("2001.01").alias("start_date"), F.lit("2002.01").alias("end_date")))).alias("w")
    ).select("id", "w.*").filter("pos = 0 or id % 3 = 0")
    merged = normalize.merge_work(stored, normalize.work_from_text(people), as_of)
    item = F.struct("position", "company_name", "title", "start_date", "end_date")
    rows = merged.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("work_experiences"))
    info = F.struct(F.when(c("id") % 4 == 0, 7).alias("work_years"), none.alias("summary"), none.alias("self_evaluation"))
    years = normalize.resume_years(rows.withColumns({"basic_info": info, "raw_text": F.lit(""), "skills": F.array().cast("array<struct<years:int>>")}), as_of)
    return years.select(c("id").alias("resume_id"), F.array_join(F.transform("work_experiences", lambda w: F.concat_ws("/", w["company_name"], w["title"], w["start_date"], w["end_date"])), "|").alias("history"), "years")


@query(
    "summaries_shown",
    with_ctes(["fx_people"], """SELECT resume_id, CASE resume_id % 3 WHEN 0 THEN concat_ws('; ', title, city, 'Go, Vue', 'site') WHEN 1 THEN summary ELSE concat(substr(repeat(concat('word ', summary, ' '), 60), 1, 500), '…') END AS shown FROM fx_people"""),
)
def summaries_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = F.col, F.col("resume_id") % 3
    summary = F.when(n == 0, "电话 13800000000").when(n == 1, F.concat("summary", F.lit("  "))).otherwise(F.repeat(F.concat(F.lit("word "), "summary", F.lit(" ")), F.lit(60)))
    names = lambda *values: F.array(*[F.struct(F.lit(v).alias("name")) for v in values])
    rows = bind(spark, sf_dir, "fx_people").select("resume_id", F.struct(summary.alias("summary"), c("title").alias("current_title"), c("city").alias("current_city")).alias("basic_info"), names("Go", "Vue").alias("skills"), names("site").alias("projects"))
    return normalize.display_summary(rows).select("resume_id", c("display_summary").alias("shown"))


@query("imported_openings", "SELECT CASE WHEN c_custkey IS NULL THEN 'new' ELSE 'updated' END AS status, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 = 0) o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) c ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT 'kept', count(*) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def imported_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = read(spark, sf_dir, "orders").schema["o_orderdate"].dataType
    store = read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.lit("1990-01-01").cast(kind).alias("updated_at"))
    new = read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("updated_at"))
    return maintain.import_jobs(maintain.seed_if_empty(store, new), new)[1]


@query(
    "observed_import",
    """WITH s AS (SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey % 2 = 0), u AS (SELECT o_custkey AS id, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderkey % 3 = 0) WHERE place = 1)
 SELECT coalesce(u.id, s.id) AS id, CASE WHEN u.id IS NULL THEN s.value ELSE u.value END AS value, count(*) FILTER (s.id IS NULL) OVER () AS n_new, count(*) FILTER (s.id IS NOT NULL AND u.id IS NOT NULL) OVER () AS n_updated, count(*) FILTER (u.id IS NULL) OVER () AS n_kept FROM s FULL JOIN u ON s.id = u.id""",
)
def observed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as the import wrote it, with the counts that were gathered on the way."""
    c = F.col
    kind = read(spark, sf_dir, "orders").schema["o_orderdate"].dataType
    store = read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(c("c_custkey").alias("id"), c("c_acctbal").alias("value"), F.lit("1990-01-01").cast(kind).alias("updated_at"))
    new = read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(c("o_custkey").alias("id"), c("o_totalprice").alias("value"), c("o_orderdate").alias("updated_at"), "o_orderkey")
    folder = new_folder(spark, "import")
    counts = maintain.import_observed(store, new, lambda table: table.write.parquet(folder), tie=["o_orderkey"])
    return spark.read.parquet(folder).select("id", "value", *[F.lit(counts[n]).cast("long").alias(f"n_{n}") for n in ("new", "updated", "kept")])


@query("person_roles", with_ctes(["fx_people"], f"""SELECT resume_id, CASE WHEN resume_id % 4 = 0 THEN concat('stored ', city) ELSE nullif(split_part({sql_categories(_PERSON, D.ROLE_KEYWORDS)}, ',', 1), '') END AS role FROM fx_people"""))
def person_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records of JSON payloads: a role that is stored stays, else it is derived."""
    c = F.col
    stored = F.when(c("resume_id") % 4 == 0, F.struct(F.array(F.concat(F.lit("stored "), "city")).alias("role_categories")))
    payload = F.to_json(F.struct(F.struct(c("title").alias("current_title"), "summary").alias("basic_info"), stored.alias("filter_facets")))
    rows = records.from_payload(bind(spark, sf_dir, "fx_people").select("resume_id", payload.alias("payload")), schemas.RESUME)
    return rows.select("resume_id", F.try_element_at(text.first_list(c("filter_facets.role_categories"), facets.role_categories(c("basic_info.current_title"), c("basic_info.summary"))), F.lit(1)).alias("role"))


#: Notes with all that a dump escapes, and a row that looks like a header; the octal and hex escapes are put in by hand on the way.
_NOTE = "CASE c_custkey % 8 WHEN 0 THEN concat('C:{b}new{b}tab ', c_name) WHEN 1 THEN concat('two', {chr}(10), 'lines', {chr}(9), c_name) WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN 'COPY part (p) FROM stdin;' WHEN 5 THEN concat({chr}(13), {chr}(8), {chr}(12), {chr}(11)) WHEN 6 THEN '{b}.' ELSE concat('简历 ', c_mktsegment) END"


@query("dump_tables", f"""SELECT 'people' AS "table", c_custkey AS id, {_NOTE.format(b=chr(92), chr='chr')} AS note, CAST(c_acctbal AS DOUBLE) AS amount FROM customer
 UNION ALL SELECT 'items', p_partkey, concat('A', p_name, chr(92)), NULL FROM part""")  # fmt: skip
def dump_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables written as dumps, and both read back by their headers; escapes by number are written for the second."""
    path = new_folder(spark, "dump")
    people = spark.sql(f"SELECT c_custkey AS id, {_NOTE.format(b=chr(92) * 2, chr='char')} AS note, c_acctbal AS amount FROM {{t}}", t=read(spark, sf_dir, "customer"))
    items = read(spark, sf_dir, "part").select(F.col("p_name").alias("note"), F.col("p_partkey").alias("id"))
    dumps.write_dump({"people": people, "items": items}, path)
    raw = dumps.read_dump(spark, f"{path}/items", "items")  # by its blocks: a file that is read in several splits has one header only
    dumps.write_fields(raw.select(F.concat(F.lit("\\101"), F.col("fields")[0], F.lit("\\x5C")).alias("note"), F.col("fields")[1].alias("id")), "items", f"{path}/numbered")
    found = dumps.read_dump_table(spark, f"{path}/people", "people", {"id": "bigint", "note": "string", "amount": "double"}).select(F.lit("people").alias("table"), "id", "note", "amount")
    other = dumps.read_dump_table(spark, f"{path}/numbered", "items", {"id": "bigint", "note": "string", "amount": "double"}).select(F.lit("items").alias("table"), "id", "note", "amount")
    return found.unionByName(other)


_JOB_TEXT = "lower(concat_ws(' ', title, summary))"


def _postings(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    """Flat openings of the standard layout; every tenth has a longer summary if ``changed``, the next of each ten another company."""
    c, n = F.col, F.col("job_id") % 10
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], records.RAW).schema.fields}
    more = F.when((n == 0) & F.lit(changed), F.concat("summary", F.lit(" golang devops"))).otherwise(c("summary"))
    by = F.when((n == 1) & F.lit(changed), F.concat("company", F.lit(" Ltd"))).otherwise(c("company"))
    given = {"id": F.concat(F.lit("p"), "job_id"), "title": c("title"), "summary": more, "company": by, "location": c("location")}
    raw = bind(spark, sf_dir, "fx_text").select(*[given.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in kinds.items()])
    return records.map_boards(raw)


@query(
    "retag_refresh",
    with_ctes(["fx_text"], f"""SELECT concat('p', job_id) AS id, job_id % 10 <= 1 OR contains({_JOB_TEXT}, 'kafka') AS stale, CASE WHEN job_id % 10 = 0 THEN roles <> before ELSE false END AS other_roles, job_id % 10 = 0 AS other_text, roles FROM
 (SELECT *, {sql_categories(_JOB_TEXT, D.ROLE_KEYWORDS)} AS before, {sql_categories(f"CASE WHEN job_id % 10 = 0 THEN concat({_JOB_TEXT}, ' golang devops') ELSE {_JOB_TEXT} END", D.ROLE_KEYWORDS)} AS roles FROM fx_text)"""),
)
def retag_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: openings normalised and marked, then a tenth changes its text, a tenth its company, and a dictionary learns a word."""
    as_of, c = F.to_date(F.lit("2024-01-31")), F.col
    old, now = staged(_postings(spark, sf_dir, False)), staged(_postings(spark, sf_dir, True))
    entries = retagging.dictionary_entries()
    nothing = spark.createDataFrame([], normalize.normalize_jobs(old, as_of).schema)
    first = retagging.refresh_tags(nothing, spark.createDataFrame([], "id string, fingerprint string"), old, as_of, entries)
    again = retagging.refresh_tags(first.table, first.marks, now, as_of, entries | {"topic/streams": ("kafka",)})
    rows = again.table.select("id", F.array_join("filter_facets.role_categories", ",").alias("roles"))
    rows = rows.join(again.stale.withColumn("stale", F.lit(True)), "id", "left").join(again.changed.select("id", "changed"), "id", "left")
    has = lambda name: F.coalesce(F.array_contains("changed", name), F.lit(False))
    return rows.select("id", F.coalesce("stale", F.lit(False)).alias("stale"), has("role_names").alias("other_roles"), has("payload").alias("other_text"), "roles")


@query(
    "payloads_rebuilt",
    with_ctes(["fx_text"], f"""SELECT concat('p', job_id) AS id, CASE WHEN job_id % 5 = 0 THEN 'Company Pending' ELSE company END AS company, CASE WHEN job_id % 7 = 0 THEN 'Untitled Role' ELSE title END AS title,
 CASE WHEN job_id % 3 = 0 THEN 'stored_role' ELSE found END AS roles, concat_ws(',', CASE WHEN job_id % 2 = 0 THEN 'general:Kept' END, CASE WHEN found <> '' THEN array_to_string(list_transform(string_split(found, ','), lambda x: concat('role:', x)), ',') END) AS tags,
 CAST(CASE WHEN job_id % 4 = 0 THEN 1 ELSE 2 END AS INT) AS n_required, CASE WHEN job_id % 3 <> 0 THEN CAST(min_years AS DOUBLE) END AS min_years FROM
 (SELECT *, {sql_categories("lower(concat_ws(' ', CASE WHEN job_id % 7 = 0 THEN 'Untitled Role' ELSE title END, summary, CASE WHEN job_id % 2 = 0 THEN 'Kept' END))", D.ROLE_KEYWORDS)} AS found FROM fx_text)"""),
)
def payloads_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON of openings as records in use: defaults, drops, standard tags made anew, facets where there are none."""
    c, n = F.col, F.col("job_id")
    rows = bind(spark, sf_dir, "fx_text")
    on = lambda k, value: F.when(n % k != 0, value)
    tag = lambda name, category, std: F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), F.lit(std).alias("filterable"))
    payload = F.to_json(F.struct(
        F.concat(F.lit("p"), n).alias("id"), on(5, c("company")).alias("company"), F.struct(on(7, c("title")).alias("title"), c("summary")).alias("basic_info"),
        F.struct(F.array(F.struct(F.lit("Go").alias("name")), F.struct(F.when(n % 4 == 0, " ").otherwise("Vue").alias("name"))).alias("required")).alias("skill_requirements"), F.struct(c("min_years").cast("double").alias("min_total_years")).alias("experience_requirements"),
        F.when(n % 2 == 0, F.array(tag("Kept", "general", False), tag("old", "role", True))).otherwise(F.array(tag("old", "role", True))).alias("tags"), F.when(n % 3 == 0, F.struct(F.array(F.lit("stored_role")).alias("role_categories"))).alias("filter_facets"),
    ))
    typed = records.from_payload(rows.select(payload.alias("payload")), schemas.JOB)
    out = normalize.rebuilt_openings(typed, F.to_date(F.lit("2024-01-31")))
    shown = F.array_join(F.transform(F.filter("tags", lambda t: t["category"].isin("general", "role")), lambda t: F.concat_ws(":", t["category"], t["name"])), ",")
    f = c("filter_facets")
    return out.select("id", "company", c("basic_info.title").alias("title"), F.array_join(f["role_categories"], ",").alias("roles"), shown.alias("tags"), F.size("skill_requirements.required").alias("n_required"), f["min_experience_years"].alias("min_years"))


_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_NOUNS, _KINDS, _LEVELS = ("ring", "widget", "bolt", "gear", "gizmo"), ("small", "red", "blue", "hot"), ("basic", "intermediate", "advanced", "expert")


def _hit(term: str, exact: bool = True) -> str:
    """DuckDB: how far a person (terms, raw) has a term."""
    text = f"WHEN contains(raw, {term}) THEN 0.85 " if exact else ""
    return f"CASE WHEN list_contains(terms, {term}) THEN 1.0 {text}WHEN len(list_filter(terms, lambda x: contains(x, {term}) OR contains({term}, x))) > 0 THEN 0.7 ELSE 0.0 END"


_PICK = lambda key, words: f"CASE {key} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


@query(
    "engine_matches",
    with_ctes(["fx_pairs"], f"""WITH r AS (SELECT c_custkey AS resume_id, CAST(c_custkey % 13 + 1 AS DOUBLE) AS years, concat('notes of gear', CASE WHEN c_custkey % 3 = 0 THEN ' red things' ELSE '' END) AS raw, c_custkey % 5 AS own_level, CAST(c_custkey % 4 AS DOUBLE) AS own_years, {_PICK("c_custkey", _NOUNS)} AS noun,
 list_distinct(list_filter([{_PICK("c_custkey", _NOUNS)}, CASE WHEN c_custkey % 7 > 0 THEN {_PICK("(c_custkey // 5)", _KINDS)} END, CASE WHEN c_custkey % 6 = 0 THEN 'vue' END], lambda x: x IS NOT NULL)) AS terms FROM customer),
 j AS (SELECT p_partkey AS job_id, p_size, {_W1} AS w1, {_W2} AS w2 FROM part WHERE p_partkey % 50 <> 0),
 h AS (SELECT resume_id, p.job_id, j.job_id IS NULL AS missing, p_size, years, raw, terms, w1, w2, own_level, own_years, noun, greatest({_hit("w1")}, {_hit("w2")}) AS c1, greatest({_hit("'unit'")}, {_hit("w1")}) AS c2, greatest({_hit("'vue.js work'")}, CASE WHEN list_contains(terms, 'vue') THEN 0.8 ELSE 0 END) AS c3,
  greatest({_hit("concat(w2, ' maker')")}, {_hit("w1", False)}) AS b FROM fx_pairs p JOIN r USING (resume_id) LEFT JOIN j ON p.job_id = j.job_id),
 e AS (SELECT *, CASE WHEN c1 = 0 THEN 0.0 WHEN p_size % 3 = 0 THEN c1 * 0.75 + CASE WHEN p_size % 9 = 0 THEN 1.0 ELSE least(years / (p_size % 9), 1.0) END * 0.25 ELSE c1 END AS s1, CASE WHEN p_size % 4 = 0 THEN c2 END AS s2, CASE WHEN p_size % 7 = 0 THEN c3 END AS s3 FROM h),
 m AS (SELECT *, (s1 + coalesce(s2, 0) + coalesce(s3, 0)) / (1 + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT) AS core, CASE WHEN p_size % 2 = 0 THEN b END AS plus, CASE WHEN p_size % 5 <> 0 THEN CASE WHEN p_size % 9 = 0 THEN 1.0 ELSE least(years / (p_size % 9), 1.0) END END AS total,
  CASE WHEN noun = w2 THEN (1.0 + CASE WHEN p_size % 5 = 0 THEN 0 WHEN own_level = 0 THEN 0.65 ELSE least(own_level / (p_size % 5)::DOUBLE, 1.0) END + CASE WHEN p_size % 4 = 0 THEN least(own_years / 3.0, 1.0) ELSE 0 END) / (1 + (p_size % 5 > 0)::INT + (p_size % 4 = 0)::INT) ELSE 0.0 END AS r1, CASE WHEN list_contains(terms, w1) THEN 1.0 ELSE 0.0 END AS r2 FROM e)
 SELECT resume_id, job_id, CASE WHEN missing THEN 'job_missing' ELSE 'matched' END AS status, CASE WHEN NOT missing THEN round((core * 0.6E0 + coalesce(plus * 0.15E0, 0) + coalesce(total * 0.25E0, 0)) / (0.6E0 + CASE WHEN plus IS NULL THEN 0 ELSE 0.15E0 END + CASE WHEN total IS NULL THEN 0 ELSE 0.25E0 END), 6) END AS experience,
  CASE WHEN NOT missing THEN round((r1 + r2) / 2, 6) END AS required FROM m"""),
)
def engine_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings and people as stored JSON, typed and rebuilt, then matched by the engine: what it decides of a pair, experience and required skills."""
    c, size = F.col, F.col("p_size")
    pick = lambda key, words: F.element_at(F.array(*[F.lit(w) for w in words]), (key % len(words) + 1).cast("int"))
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    some = lambda *values: F.array_compact(F.array(*values))
    none = F.lit(None).cast("string")
    item = lambda kind, name, words, least: F.struct(F.lit(kind).alias("type"), name.alias("name"), F.array(*words).alias("keywords"), least.cast("double").alias("min_years"))
    no_years = F.lit(None)
    core = some(item("domain", word(1), [word(2)], F.when(size % 3 == 0, size % 9)), F.when(size % 4 == 0, item("tech", F.lit("unit"), [word(1)], no_years)), F.when(size % 7 == 0, item("domain", F.lit("Vue.js work"), [none], no_years)))
    bonus = some(F.when(size % 2 == 0, F.struct(F.lit("project").alias("type"), F.concat(word(2), F.lit(" maker")).alias("name"), (size % 4).alias("weight"), word(1).alias("description"))))
    level = F.when(size % 5 > 0, pick(size % 5 - 1 + 4, _LEVELS))
    required = F.array(F.struct(word(2).alias("name"), level.alias("level"), F.when(size % 4 == 0, 3.0).alias("min_years")), F.struct(word(1).alias("name"), none.alias("level"), F.lit(None).cast("double").alias("min_years")), F.struct(F.lit(" ").alias("name"), none.alias("level"), F.lit(None).cast("double").alias("min_years")))
    payload = F.struct(c("p_partkey").cast("string").alias("id"), F.struct(F.lit("Role").alias("title")).alias("basic_info"), F.struct(required.alias("required")).alias("skill_requirements"), F.struct(core.alias("core"), bonus.alias("bonus"), F.when(size % 5 != 0, (size % 9).cast("double")).alias("min_total_years")).alias("experience_requirements"))
    stored = spread(read(spark, sf_dir, "part"), "p_partkey").filter("p_partkey % 50 <> 0").select(F.to_json(payload).alias("payload"))
    by_key = lambda df: staged(df.withColumn("id", c("id").cast("long")))  # noqa: E731 - pairs have keys of this type and are dealt by them
    jobs = by_key(normalize.rebuilt_openings(records.from_payload(stored, schemas.JOB), F.to_date(F.lit("2024-01-31"))))
    key = c("c_custkey")
    skill = lambda name, own, years: F.struct(name.alias("name"), own.alias("level"), years.cast("int").alias("years"))
    skills = some(skill(pick(key, _NOUNS), F.when(key % 5 > 0, pick(key % 5 - 1 + 4, _LEVELS)), key % 4), F.when(key % 7 > 0, skill(pick(F.floor(key / 5), _KINDS), none, no_years)), F.when(key % 6 == 0, skill(F.lit("Vue"), none, no_years)))
    person = F.struct(key.cast("string").alias("id"), F.struct((key % 13 + 1).cast("int").alias("work_years")).alias("basic_info"), skills.alias("skills"), F.concat(F.lit("Notes of gear"), F.when(key % 3 == 0, " red things").otherwise("")).alias("raw_text"), *[F.array().cast("array<string>").alias(n) for n in ("work_experiences", "projects", "tags")])
    people = by_key(records.from_payload(spread(read(spark, sf_dir, "customer"), "c_custkey").select(F.to_json(person).alias("payload")), schemas.RESUME))
    scored = engine.score_pairs(bind(spark, sf_dir, "fx_pairs"), jobs, people, None, F.to_date(F.lit("2024-01-31")))
    known = c("status") != "job_missing"
    return scored.select("resume_id", "job_id", "status", F.when(known, F.round("experience", 6)).alias("experience"), F.when(known, F.round("required", 6)).alias("required"))


@query("json_lists", """SELECT o_orderkey AS id, concat('Order, "', o_orderpriority, '" [', o_custkey, ']') AS title, o_totalprice AS value FROM orders""")
def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as files of one list each, read back in blocks; some 50,000 orders a file."""
    c = F.col
    title = F.concat(F.lit('Order, "'), c("o_orderpriority"), F.lit('" ['), c("o_custkey").cast("string"), F.lit("]"))
    rows = read(spark, sf_dir, "orders").select(F.to_json(F.struct(c("o_orderkey").alias("id"), title.alias("title"), c("o_totalprice").alias("value"))).alias("text"), "o_orderkey")
    files = max(1, -(-rows.count() // 50_000))
    number = F.pmod(F.xxhash64("o_orderkey"), F.lit(files).cast("long"))
    lines = rows.withColumn("file", number).withColumn("first", F.row_number().over(W.partitionBy("file").orderBy("o_orderkey")) == 1)
    body = lines.select("file", F.lit(0).alias("part"), "o_orderkey", F.concat(F.when(c("first"), "[").otherwise(","), "text").alias("value"))
    ends = lines.filter("first").select("file", F.lit(1).alias("part"), "o_orderkey", F.lit("]").alias("value"))
    folder = new_folder(spark, "lists")
    body.unionByName(ends).repartition(int(files), "file").sortWithinPartitions("file", "part", "o_orderkey").select("file", "value").write.partitionBy("file").text(folder)
    read_back = json_arrays.read_elements(spark, f"{folder}/*/*.txt")
    return read_back.select(F.from_json("text", "id long, title string, value double").alias("r")).select("r.*")
