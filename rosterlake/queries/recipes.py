"""Domain rows derived from the given tables by SQL both engines read alike.

The tables hold no mail, sheets or people, so names, notices, sheets and
records are composed from keys and dates, one per source row.
"""


def person(k: str) -> str:
    return (
        f"concat(substr('赵钱孙李周吴郑王冯陈褚卫', cast(({k}) % 12 AS int) + 1, 1), "
        f"substr('伟芳娜敏静丽强磊军洋', cast(({k}) % 10 AS int) + 1, 1))"
    )


def pad(x: str, n: int = 2) -> str:
    return f"lpad(cast({x} AS string), {n}, '0')"


def block(k: str, n: int) -> str:
    return f"cast(floor({k} / {n}) AS bigint)"


_Y, _M, _D = "cast(year(o_orderdate) AS string)", "cast(month(o_orderdate) AS string)", "cast(day(o_orderdate) AS string)"
_MM, _DD = pad("month(o_orderdate)"), pad("day(o_orderdate)")
_NEXT = "cast(month(o_orderdate) % 12 + 1 AS string)"

# One leave notice mail per order, in several writings, some of them no notice.
LEAVE_MAILS = f"""
SELECT o_orderkey, concat('m', {pad('o_orderkey', 12)}) AS source_id, cast(o_orderdate AS date) AS mail_date,
  concat('各位同事：', chr(10),
    CASE o_orderkey % 6
      WHEN 0 THEN concat({person('o_custkey')}, '（', cast(10000 + o_custkey AS string), '）申请离职，预计', {_NEXT}, '月', {_D}, '日离职生效')
      WHEN 1 THEN concat({person('o_custkey')}, '(', cast(10000 + o_custkey AS string), ') 离职日期 ', {_Y}, '-', {_MM}, '-', {_DD})
      WHEN 2 THEN concat({person('o_custkey')}, '（', cast(10000 + o_custkey AS string), '）和', {person('o_custkey + 5')}, '（', cast(30000 + o_custkey AS string), '）离岗，', {_Y}, '年', {_MM}, '月', {_DD}, '日')
      WHEN 3 THEN concat('  ', {person('o_custkey')}, '（', cast(10000 + o_custkey AS string), '）', {_M}, '月', {_D}, '日')
      WHEN 4 THEN concat({_M}, '月', {_D}, '日开会讨论减员方案')
      ELSE '今天没有变动' END, chr(10),
    CASE o_orderkey % 5
      WHEN 0 THEN concat({person('o_custkey')}, '（', cast(10000 + o_custkey AS string), '）解除合同 ', {_Y}, '/', {_M}, '/', {_D})
      WHEN 1 THEN concat({person('o_custkey + 7')}, '（', cast(20000 + o_custkey AS string), '）退场 13月40日')
      WHEN 2 THEN concat({person('o_custkey + 3')}, '（', cast(40000 + o_custkey AS string), '）停保')
      ELSE '此致' END) AS body
FROM {{orders}}"""

# Date texts in many layouts, some invalid.
DATE_TEXTS = f"""
SELECT o_orderkey, cast(o_orderdate AS date) AS d,
  CASE o_orderkey % 16
    WHEN 0 THEN concat({_Y}, '-', {_MM}, '-', {_DD})
    WHEN 1 THEN concat({_Y}, '/', {_M}, '/', {_D})
    WHEN 2 THEN concat({_Y}, '年', {_M}, '月', {_D}, '日')
    WHEN 3 THEN concat({_Y}, {_MM}, {_DD})
    WHEN 4 THEN concat({_Y}, '-', {_MM}, '-', {_DD}, 'T10:30:00')
    WHEN 5 THEN concat({_Y}, '-', {_MM})
    WHEN 6 THEN concat({_Y}, {_MM})
    WHEN 7 THEN concat({_Y}, '年', {_M}, '月')
    WHEN 8 THEN concat({_DD}, '/', {_MM}, '/', {_Y})
    WHEN 9 THEN concat({_Y}, '.', {_MM}, '.', {_DD})
    WHEN 10 THEN concat({_M}, '月', {_D}, '日')
    WHEN 11 THEN concat({_Y}, '-02-30')
    WHEN 12 THEN 'not_a_date'
    WHEN 13 THEN cast(35000 + o_orderkey % 9000 AS string)
    WHEN 14 THEN concat('离职日 ', {_Y}, '-', {_M}, '-', {_D}, ' 生效')
    ELSE '' END AS t
FROM {{orders}}"""

# Quoted threads below conversation turns.
THREADS = """
SELECT conv_id, turn, concat(cast(conv_id AS string), '-', cast(turn AS string)) AS source_id,
  concat(text, chr(10),
    CASE (conv_id + turn) % 9
      WHEN 0 THEN '----- 原始邮件 -----'
      WHEN 1 THEN '---Original  Message---'
      WHEN 2 THEN ' On Monday, somebody wrote: '
      WHEN 3 THEN concat('发件人: a', chr(10), '发送时间: b', chr(10), 'To: c', chr(10), '主题: d')
      WHEN 4 THEN '--------'
      WHEN 5 THEN 'Begin forwarded message:'
      WHEN 6 THEN concat('From: a', chr(10), 'Sent: b')
      WHEN 7 THEN '-- short dashes'
      ELSE 'no quote here' END, chr(10), 'quoted ', role, chr(10), 'Date: then') AS text
FROM {conversations}"""

# Sheets of a hundred customers in four layouts, ten sheets per workbook.
_SHEET = block("c_custkey", 100)
_ISO = f"concat('2025-', {pad('c_custkey % 12 + 1')}, '-', {pad('c_custkey % 28 + 1')})"
SHEET_ROWS = f"""
SELECT concat('wb', {pad(block('c_custkey', 1000), 8)}) AS source_id, cast({_SHEET} % 10 AS int) AS sheet_idx,
  concat(CASE {_SHEET} % 4 WHEN 0 THEN '在职人员' WHEN 1 THEN '社保减员' WHEN 2 THEN '数据' ELSE '离职名单' END, cast({_SHEET} % 10 AS string)) AS sheet_name,
  cast({_SHEET} % 4 AS int) AS variant,
  cast(c_custkey % 100 + CASE {_SHEET} % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS int) AS row_idx,
  CASE {_SHEET} % 4 WHEN 0 THEN cast(c_custkey % 100 + 1 AS string) ELSE {person('c_custkey')} END AS v0,
  CASE {_SHEET} % 4 WHEN 0 THEN {person('c_custkey')} WHEN 1 THEN concat('4201011990', {pad('c_custkey', 8)}) WHEN 2 THEN cast(600000 + c_custkey AS string) ELSE replace(c_name, '#', ' ') END AS v1,
  CASE {_SHEET} % 4 WHEN 0 THEN cast(600000 + c_custkey AS string) WHEN 1 THEN cast(c_nationkey * 100 AS string) WHEN 2 THEN {_ISO} ELSE cast(700000 + c_custkey AS string) END AS v2,
  CASE {_SHEET} % 4 WHEN 0 THEN {_ISO} WHEN 1 THEN concat('2025-', {pad('c_custkey % 12 + 1')}) WHEN 2 THEN cast(c_nationkey AS string) ELSE cast(600000 + c_custkey AS string) END AS v3,
  CASE {_SHEET} % 4 WHEN 0 THEN CASE c_nationkey % 3 WHEN 0 THEN '研发部' WHEN 1 THEN '' ELSE '销售部' END WHEN 1 THEN cast(c_nationkey * 10 AS string) WHEN 2 THEN '在职' ELSE replace({_ISO}, '-', '/') END AS v4,
  CASE {_SHEET} % 4 WHEN 0 THEN cast(c_nationkey * 7 AS string) WHEN 1 THEN concat('2025/', cast(c_custkey % 12 + 1 AS string)) WHEN 2 THEN concat(c_mktsegment, '有限公司') ELSE CASE c_custkey % 2 WHEN 0 THEN '个人原因' ELSE '合同到期' END END AS v5
FROM {{customer}}"""

# Header cells per layout: (variant, row, column, text).
SHEET_HEADERS = """
SELECT * FROM (VALUES
  (0, 0, 0, '人员名单'), (0, 1, 0, '序号'), (0, 1, 1, '姓名'), (0, 1, 2, '员工工号'), (0, 1, 3, '入职日期'), (0, 1, 4, '部门'), (0, 1, 5, '月缴费工资'),
  (1, 0, 0, '员工'), (1, 0, 1, '员工'), (1, 0, 2, '社保'), (1, 0, 3, '社保'), (1, 0, 4, '公积金'), (1, 0, 5, '公积金'),
  (1, 1, 0, '姓名'), (1, 1, 1, '证件号码'), (1, 1, 2, '缴费金额'), (1, 1, 3, '离职月份'), (1, 1, 4, '缴费金额'), (1, 1, 5, '离职月份'),
  (3, 0, 0, '姓名'), (3, 0, 1, '姓名(英文)'), (3, 0, 2, '工号'), (3, 0, 3, '员工工号'), (3, 0, 4, '离职日期'), (3, 0, 5, '离职原因')
) AS h(variant, row_idx, col_idx, raw)"""

SHEET_CELLS = f"""
SELECT source_id, sheet_idx, sheet_name, row_idx, col_idx, raw FROM (
  SELECT source_id, sheet_idx, sheet_name, row_idx, 0 AS col_idx, v0 AS raw FROM ({SHEET_ROWS}) a
  UNION ALL SELECT source_id, sheet_idx, sheet_name, row_idx, 1, v1 FROM ({SHEET_ROWS}) a
  UNION ALL SELECT source_id, sheet_idx, sheet_name, row_idx, 2, v2 FROM ({SHEET_ROWS}) a
  UNION ALL SELECT source_id, sheet_idx, sheet_name, row_idx, 3, v3 FROM ({SHEET_ROWS}) a
  UNION ALL SELECT source_id, sheet_idx, sheet_name, row_idx, 4, v4 FROM ({SHEET_ROWS}) a
  UNION ALL SELECT source_id, sheet_idx, sheet_name, row_idx, 5, v5 FROM ({SHEET_ROWS}) a
  UNION ALL SELECT s.source_id, s.sheet_idx, s.sheet_name, h.row_idx, h.col_idx, h.raw
  FROM (SELECT DISTINCT source_id, sheet_idx, sheet_name, variant FROM ({SHEET_ROWS}) b) s JOIN ({SHEET_HEADERS}) h ON s.variant = h.variant
) c WHERE raw <> ''"""

# Records of fifty orders per source in six shapes.
_SRC = block("o_orderkey", 50)
_NAT = f"concat('4201011990', {pad('o_custkey', 7)}, 'X')"
_RISO = f"concat({_Y}, '-', {_MM}, '-', {_DD})"
RECORD_ROWS = f"""
SELECT concat('s', {pad(_SRC, 9)}) AS source_id, cast({_SRC} % 6 AS int) AS variant,
  concat(CASE {_SRC} % 6 WHEN 0 THEN '入职名单' WHEN 1 THEN '离职名单' WHEN 2 THEN '在职员工' WHEN 3 THEN '离职通知' WHEN 4 THEN '花名册' ELSE '汇总' END,
    cast({_SRC} AS string), CASE {_SRC} % 6 WHEN 3 THEN '.eml' ELSE '.xlsx' END) AS source_file,
  CASE {_SRC} % 6 WHEN 3 THEN 'email' ELSE 'excel' END AS source_type, '' AS parent_source_id,
  CASE {_SRC} % 6 WHEN 3 THEN '' ELSE CASE o_orderkey % 4 WHEN 0 THEN '增员' WHEN 1 THEN '减员' WHEN 2 THEN '离职_1' ELSE '人员' END END AS sheet_name,
  cast(o_orderkey % 4 AS int) AS sheet_idx, cast(o_orderkey % 50 AS int) AS row_idx, o_orderkey, o_custkey,
  {person('o_custkey')} AS nm,
  CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN {_NAT} ELSE cast(10000 + o_custkey AS string) END AS idn,
  CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '待定' WHEN 2 THEN concat({_Y}, '/', {_M}, '/', {_D}) ELSE {_RISO} END AS dt,
  CASE o_orderkey % 3 WHEN 0 THEN '增' WHEN 1 THEN '减员' ELSE '新增' END AS kind,
  CASE o_orderkey % 2 WHEN 0 THEN '个人原因' ELSE '' END AS reason,
  {_RISO} AS iso_date, o_orderpriority AS prio, o_orderstatus AS status
FROM {{orders}}"""
