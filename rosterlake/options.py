"""Settings a caller may override; all defaults are plain values."""
from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class IntentWords:
    """Words that tell an addition from a removal. Fixed values."""

    add: tuple[str, ...] = ("增员", "入职", "新增", "新入职", "新增人员", "加员", "扩员")
    remove: tuple[str, ...] = ("减员", "离职", "退场", "辞退", "解除", "退工", "停保", "退保")
    in_service: tuple[str, ...] = ("在职", "在岗", "在册")
    add_files: tuple[str, ...] = ("增员", "入职")
    remove_files: tuple[str, ...] = ("减员", "离职")
    declare_headers: tuple[str, ...] = (
        "社保/申报类型", "申报类型", "社保类型", "变动类型", "办理类型", "业务类型", "操作类型",
    )
    fee_month_keys: tuple[str, ...] = (
        "费用年月", "缴费年月", "参保月份", "申报月份", "社保月份", "所属期", "费用月份", "缴费月份", "参保年月", "申报年月",
    )
    fee_month_anchors: tuple[str, ...] = ("费用", "缴费", "参保", "申报", "社保", "所属")
    fee_month_headers: tuple[str, ...] = (
        "费用年月", "缴费年月", "参保月份", "申报月份", "社保月份", "所属期", "费用月份", "缴费月份",
    )
    add_dates: tuple[str, ...] = ("入职日期", "签订日期", "生效日期", "变动日期", "办理日期")
    remove_dates: tuple[str, ...] = ("离职日期", "退保日期", "退场日期", "退工日期", "变动日期", "办理日期")
    add_date_keys: tuple[str, ...] = ("start_date", "入职日期", "到岗日期")
    remove_date_keys: tuple[str, ...] = ("leave_date", "end_date", "离职日期", "终止日期")
    remove_key_starts: tuple[str, ...] = ("terminationdate", "terminationreason")
    add_key_starts: tuple[str, ...] = (
        "startdate", "employeestatus", "employmentstatus", "monthlycontribution", "contribution", "feemonth",
    )


@dataclass(frozen=True)
class Limits:
    """Row caps; None keeps everything (the default)."""

    rows_per_sheet: int | None = None
    records_per_workbook: int | None = None
    body_chars: int | None = None
    lines_per_reply: int | None = None


REFERENCE_LIMITS = Limits(1000, 5000, 15000, 50)


@dataclass(frozen=True)
class SheetOptions:
    header_scan_rows: int | None = None
    rank_rows: int | None = None
    rank_width: int = 80
    coverage: float = 0.5
    head_rows: int = 10
    spread_rows: int = 10
    samples: int = 8
    min_useful_cells: int = 3
    serial_dates: str = "date_keys"  # or "all"
    forced_headers: dict = field(default_factory=dict)
    limits: Limits = Limits()


@dataclass(frozen=True)
class RouteOptions:
    allowed_extensions: tuple[str, ...] = ()
    allowed_types: tuple[str, ...] = ()
    overrides: dict = field(default_factory=dict)
    ignore_unknown: bool = False


@dataclass(frozen=True)
class FillOptions:
    words: IntentWords = IntentWords()
    max_sources: int | None = None  # every source that is not excluded
    match_score: int = 80
    gate_ratio: float = 0.4
    gate_top: int | None = None
    name_only_dedupe: bool = False
    allowed_columns: tuple[str, ...] = ()
    forced_columns: dict = field(default_factory=dict)
    fallback_one_source: bool = False  # forms without a plan: only the first source
