"""Header and key rules. Word lists and the keys they stand for.

A rule is (key, groups): it matches when every group has a word contained in
the text. Rules are tried in order and the first match wins.
"""

HEADER_RULES = (
    ("bank_account", (("银行账号", "银行卡号", "收款账号", "accountno", "accountnumber"),)),
    ("vendor_pay_code_name", (("供应商发薪编码名称",),)),
    ("vendor_pay_code", (("供应商发薪编码",),)),
    ("employee_id", (("个人电脑编号", "员工工号", "人员编号", "工号"),)),
    ("name", (("姓名",),)),
    ("gender", (("性别",),)),
    ("id_number", (("身份证号码", "证件号码"),)),
    ("ethnicity", (("民族",),)),
    ("education_level", (("学历",),)),
    ("employee_status", (("职工身份",),)),
    ("start_date", (("入职日期", "到岗日期"),)),
    ("start_date", (("参加保险年月",),)),
    ("monthly_contribution", (("月缴费工资",),)),
    ("household_registration", (("户口情况",),)),
    ("pension_insurance_status", (("参加保险情况",),)),
    ("termination_date", (("减员年月", "离职年月"),)),
    ("remark", (("备注",),)),
    ("contract_company", (("甲方公司",), ("合同",))),
    ("contract_start_date", (("合同起始日期",),)),
    ("contract_end_date", (("合同终止日期",),)),
    ("sign_date", (("签订日期",),)),
    ("peak_end_date", (("高峰期预计到期日期",),)),
    ("training_start_date", (("培训服务协议开始日期",),)),
    ("training_end_date", (("培训协议结束日期",),)),
    ("noncompete_sign_date", (("竞业禁止协议签订日期",),)),
    ("noncompete_end_date", (("竞业禁止解除日期",),)),
    ("org_unit", (("组织单位",),)),
    ("company", (("公司名称",),)),
    ("work_location", (("工作地",),)),
    ("region", (("所属地区",),)),
    ("position", (("职位名称", "岗位名称"),)),
    ("position_attribute", (("岗位属性",),)),
    ("employment_status", (("雇佣状态", "在职状态"),)),
    ("vendor", (("供应商",),)),
)

FALLBACK_RULES = (
    ("bank_account", (("银行账号", "银行卡号", "收款账号", "accountno", "accountnumber"),)),
    ("position_attribute", (("岗位属性", "岗位类别", "岗位序列", "一线", "二线", "三线", "职级", "层级"),)),
    ("position_attribute", (("属性",), ("岗位", "职位", "职务", "position", "title"))),
    ("position", (("职位名称", "岗位名称"),)),
    ("contract_company", (("甲方公司", "甲方", "劳动合同", "合同"), ("公司", "company"))),
    ("company", (("组织", "归属单位"),)),
    ("name", (("姓名", "=name"),)),
    ("employee_id", (("个人电脑编号",),)),
    ("employee_id", (("工号", "员工编号", "employee", "empno", "staffid"),)),
    ("id_number", (("证件", "身份证", "=id", "证号", "document"),)),
    ("ethnicity", (("民族",),)),
    ("education_level", (("学历",),)),
    ("employee_status", (("职工身份",),)),
    ("phone", (("手机号", "电话", "联系方式", "mobile", "phone", "tel"),)),
    ("start_date", (("入职", "onboard", "startdate", "参加保险年月"),)),
    ("end_date", (("离职", "退场", "offboard", "enddate", "离岗"),)),
    ("contract_start_date", (("合同起始日期",),)),
    ("contract_end_date", (("合同终止日期",),)),
    ("sign_date", (("签订日期",),)),
    ("peak_end_date", (("高峰期预计到期日期",),)),
    ("training_start_date", (("培训服务协议开始日期",),)),
    ("training_end_date", (("培训协议结束日期",),)),
    ("noncompete_sign_date", (("竞业禁止协议签订日期",),)),
    ("noncompete_end_date", (("竞业禁止解除日期",),)),
    ("birth_date", (("出生", "birth"),)),
    ("email", (("邮箱", "email"),)),
    ("department", (("部门", "department"),)),
    ("position", (("岗位", "职位", "职务", "position", "title"),)),
    ("monthly_contribution", (("月缴费工资",),)),
    ("household_registration", (("户口情况",),)),
    ("pension_insurance_status", (("参加保险情况",),)),
    ("remark", (("备注",),)),
    ("company", (("公司", "单位", "company"),)),
    ("address", (("工作地", "地区", "地址", "address"),)),
    ("amount", (("金额", "费用", "薪资", "amount", "price", "fee"),)),
    ("remark", (("说明", "comment", "remark"),)),
)

FORCED_HEADERS = {
    "姓名": "name", "性别": "gender", "个人电脑编号": "employee_id",
    "身份证号码": "id_number", "证件号码": "id_number",
    "民族": "ethnicity", "学历": "education_level", "职工身份": "employee_status",
    "参加保险年月": "start_date", "参保年月": "start_date", "缴费年月": "start_date",
    "月缴费工资": "monthly_contribution", "户口情况": "household_registration",
    "参加保险情况": "pension_insurance_status",
    "减员年月": "termination_date", "离职年月": "termination_date", "备注": "remark",
}

CORE_KEY_WORDS = {
    "employee_id": ("员工工号", "工号", "人员编号"),
    "name": ("姓名", "员工姓名"),
    "company": ("公司名称",),
    "position": ("职位名称", "岗位名称"),
    "start_date": ("入职日期", "到岗日期"),
    "date": ("日期",),
}

LOSER_RULES = (
    ("employment_status", (("雇佣状态", "在职状态"),)),
    ("subgroup", (("员工子组",),)),
    ("job_family", (("岗",), ("!岗位",), ("!职位",))),
    ("duration_unit", (("合同期限单位",),)),
    ("probation_unit", (("试用期",), ("单位",))),
    ("job_function", (("岗位职能",),)),
    ("vendor", (("供应商",),)),
    ("org_unit", (("组织单位",),)),
)

CONFLICT_RULES = (
    ("position_attribute", (("岗位属性", "一线", "二线", "三线", "职级", "层级", "序列"),)),
    ("position", (("职位名称", "岗位名称"),)),
    ("contract_company", (("甲方公司", "劳动合同"),)),
    ("company", (("公司名称", "组织"),)),
)

REMOVE_SHEET_WORDS = ("减员", "离职", "退工", "退保", "终止", "停保")
END_KEYS = (
    "termination_date", "terminationdate", "leave_date", "leavedate", "end_date", "enddate",
)
DATE_KEYS = (
    "start_date", "end_date", "leave_date", "termination_date", "contract_start_date", "contract_end_date",
    "sign_date", "peak_end_date", "training_start_date", "training_end_date", "noncompete_sign_date",
    "noncompete_end_date", "birth_date", "date", "ss_end_month", "hf_end_month", "med_end_month",
)

LEAVE_WORDS = ("离职", "申请离职", "离职生效", "离岗", "解除", "退场", "减员", "停保", "社保减员")

NAME_KEYS = ("name", "姓名", "员工姓名", "参保人")
ID_KEYS = ("id_number", "身份证号", "证件号码", "employee_id", "工号")
START_DATE_KEYS = ("start_date", "入职日期", "入职时间")
LEAVE_DATE_KEYS = ("leave_date", "end_date", "离职日期", "离职时间")
DATE_CANDIDATES = {
    "add": (
        "start_date", "startdate", "join_date", "entry_date", "hire_date", "参加保险年月", "参保年月", "增员年月",
        "feemonth", "month",
    ),
    "remove": (
        "end_date", "enddate", "termination_date", "terminationdate", "leave_date", "leavedate", "ss_end_month",
        "hf_end_month", "离职日期", "减员月份", "减员年月", "停保月份", "停保年月", "退工日期", "退保日期", "终止日期",
        "停保日期", "费用年月",
    ),
}
REASON_CANDIDATES = (
    "termination_reason", "terminationreason", "reason", "变动原因", "减员原因", "离职原因", "退工原因", "退保原因", "原因",
)

FILE_SIGNALS = {
    "add_strong": ("入职", "新增", "增员", "add", "onboard", "新入职"),
    "add_weak": ("花名册", "员工名单", "人员名单"),
    "remove_strong": ("离职", "减员", "停保", "remove", "offboard", "退出"),
    "remove_weak": ("减少", "删除"),
    "exclude": ("在职", "在岗", "active", "current"),
}
KEY_SIGNALS = {
    "name": ("姓名", "name", "员工姓名", "参保人", "被保险人"),
    "id": ("身份证", "证件号", "id", "employee_id", "工号"),
    "start": ("入职日期", "start_date", "入职时间", "开始日期", "到岗日期"),
    "end": ("离职日期", "end_date", "leave_date", "离职时间", "退出日期"),
}

PROFILE_HEADERS = {
    "name": ("姓名", "参保人姓名", "员工姓名", "被保险人"),
    "id": ("证件号码", "身份证号", "身份证", "证件号"),
    "declare": ("申报类型", "申报类别", "办理类型"),
    "fee_month": ("费用年月", "费款年月", "缴费年月", "参保年月"),
    "reason": ("变动原因", "减员原因", "离职原因", "退工原因", "退保原因", "原因", "reason"),
}

SYNONYMS = {
    "身份证号码": ("证件号码", "身份证号", "身份证", "证件号"),
    "证件号码": ("身份证号码", "身份证号", "身份证", "证件号"),
    "姓名": ("名字", "名称"),
    "名字": ("姓名", "名称"),
    "联系方式": ("电话", "手机", "联系电话", "手机号"),
    "电话": ("联系方式", "手机", "联系电话", "手机号"),
    "入职日期": ("入职时间", "入职"),
    "离职退场时间": ("离职时间", "退场时间", "离职日期", "退场日期"),
}

EXTENSION_TYPES = {
    ".xlsx": "excel", ".xls": "excel",
    ".docx": "email", ".txt": "email", ".eml": "email",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".gif": "image", ".bmp": "image", ".webp": "image",
    ".md": "text", ".csv": "text", ".json": "text", ".xml": "text", ".html": "text", ".htm": "text",
    ".log": "text", ".rtf": "text",
}
SOURCE_TYPES = ("excel", "email", "image", "text", "other")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".svg")
CONTENT_TYPE_EXTENSIONS = {
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.ms-excel": ".xls",
    "text/csv": ".csv",
    "application/csv": ".csv",
    "application/pdf": ".pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/msword": ".doc",
}
CONTAINER_KEYS = ("data", "records", "rows", "items", "extracted_data", "table_data")
NOT_MERGED_KEYS = (
    "data", "records", "rows", "items", "metadata", "warnings", "extracted_data", "table_data", "tables", "numbers",
    "extracted_fields",
)
