"""Texts, code labels and priorities that results must carry unchanged."""

# Five risk levels as (code, name, colour), cut-offs in contract.LEVEL_CUTOFFS.
RISK_LEVELS = [
    (1, "I级：健康", "#16a34a"),
    (2, "II级：关注", "#ca8a04"),
    (3, "III级：中危", "#ea580c"),
    (4, "IV级：高危", "#dc2626"),
    (5, "V级：极高危", "#b91c1c"),
]

# Validation reasons.
REASON_NOT_NUMBER = "必须是数字"
REASON_NOT_FINITE = "必须是有限数字"
REASON_NOT_CODE = "必须是整数编码"
REASON_RANGE_PREFIX = "取值范围为 "

# Highlight sentences.
HIGHLIGHT_HYPERTENSION = "存在高血压特征，提示心脑血管负担增加"
HIGHLIGHT_CHOLESTEROL = "胆固醇水平偏高，存在动脉粥样硬化风险"
HIGHLIGHT_DIABETES = "存在糖尿病特征，需要关注代谢与血管风险"
HIGHLIGHT_SMOKER = "存在吸烟相关行为，会增加心脏和脑卒中风险"
HIGHLIGHT_ALCOHOL = "存在饮酒行为，建议关注长期心血管影响"
HIGHLIGHT_EXERCISE = "缺乏规律运动，不利于心脑血管健康管理"
HIGHLIGHT_BMI = "BMI 偏高，提示超重或肥胖相关风险"
HIGHLIGHT_PRESSURE = "本次填写的血压数值偏高，建议复测并咨询专业人员；该数值未直接进入概率模型"
HIGHLIGHT_GLUCOSE = "本次填写的空腹血糖数值偏高，建议规范复查；该数值未直接进入概率模型"
HIGHLIGHT_FAMILY = "存在心脑血管疾病家族史，建议在专业评估时主动告知医生"
HIGHLIGHT_NONE = "当前主要指标整体相对平稳，未见明显高危特征"

# Summary sentences by final category.
SUMMARY_HEALTHY = "当前评估为健康状态，未发现明显心脏或脑卒中高风险信号。"
SUMMARY_WATCH = (
    "当前两项独立模型均未达到组合高风险阈值，综合风险处于关注范围，"
    "建议继续管理危险因素。"
)
SUMMARY_HEART = "当前评估更偏向心脏负面事件风险，需要重点关注心脏相关危险因素。"
SUMMARY_STROKE = "当前评估更偏向脑卒中风险，需要重点关注脑血管相关危险因素。"
SUMMARY_BOTH = "当前评估提示心脏和脑卒中双重风险，建议尽快进行系统性检查与干预。"

# Indicator names, statuses and comments.
INDICATOR_NAMES = {
    "hypertension": "高血压",
    "cholesterol": "胆固醇",
    "diabetes": "糖尿病",
    "bmi": "BMI",
    "smoker": "吸烟状态",
    "pressure": "本次血压",
    "glucose": "空腹血糖",
}
INDICATOR_COMMENTS = {
    "hypertension": "高血压是心脑血管疾病的重要危险因素。",
    "cholesterol": "胆固醇升高与动脉粥样硬化风险相关。",
    "diabetes": "糖尿病与心脑血管共病风险密切相关。",
    "bmi": "BMI 偏高会增加高血压、糖脂代谢异常风险。",
    "smoker": "吸烟与心脏负面事件和脑卒中风险均相关。",
    "pressure": "该数值用于辅助健康提示，不直接进入当前九特征概率模型。",
    "glucose": "单次测量不能用于诊断；该数值不直接进入当前概率模型。",
}
STATUS_NORMAL = "正常"
STATUS_HYPERTENSION = "偏高风险"
STATUS_CHOLESTEROL = "偏高"
STATUS_DIABETES = "存在风险"
STATUS_BMI = "超重或肥胖倾向"
STATUS_IN_RANGE = "参考范围内"
STATUS_PRESSURE = "建议复测"
STATUS_GLUCOSE = "建议规范复查"
STATUS_UNKNOWN = "未知"

# Feature display names and code labels.
FEATURE_NAMES = {
    "age": "年龄",
    "gender": "性别",
    "bmi": "BMI",
    "cholesterol": "胆固醇情况",
    "diabetes": "糖尿病情况",
    "hypertension": "高血压情况",
    "smoker": "吸烟情况",
    "alcohol": "饮酒情况",
    "exercise": "运动情况",
}
CODE_LABELS = {
    "gender": {0: "女", 1: "男"},
    "cholesterol": {1: "正常", 2: "偏高", 3: "明显升高"},
    "diabetes": {0: "无", 1: "有"},
    "hypertension": {0: "无", 1: "有"},
    "smoker": {0: "从不吸烟", 1: "曾经吸烟", 2: "当前吸烟"},
    "alcohol": {0: "不饮酒", 1: "饮酒"},
    "exercise": {0: "不规律", 1: "规律"},
}

# Advice by factor, with its priority and short name.
FACTOR_PRIORITY = {
    "hypertension": 70,
    "smoker": 60,
    "diabetes": 50,
    "cholesterol": 40,
    "bmi": 30,
    "exercise": 20,
    "alcohol": 10,
}
FACTOR_SHORT_NAMES = {
    "hypertension": "血压",
    "smoker": "吸烟",
    "diabetes": "血糖",
    "cholesterol": "血脂",
    "bmi": "体重",
    "exercise": "活动量",
    "alcohol": "饮酒",
}
FACTOR_ACTIONS = {
    "hypertension": "从今天开始记录早晚血压；如已在用药，请按医嘱坚持服用，不要自行停药。",
    "smoker": "先定一个明确的戒烟日期，并告诉家人；需要时可到戒烟门诊寻求帮助。",
    "diabetes": "规律记录血糖，少喝含糖饮料，并按医嘱复查血糖和糖化血红蛋白。",
    "cholesterol": "下一餐先少一点油炸和肥肉，多选蔬菜、全谷物、鱼类或豆制品。",
    "bmi": "先从每天少一份高热量零食、饭后步行 20 分钟开始，逐步管理体重。",
    "exercise": "从每天步行 20 分钟开始，循序渐进；运动时如有胸闷、胸痛或明显不适请立即停止。",
    "alcohol": "本周先安排无酒日，逐步减少饮酒次数和饮酒量，不用饮酒来预防心血管病。",
}
FOLLOW_UP_GUIDANCE = {
    1: "保持现有健康习惯，建议每 12 个月复查一次血压、血脂和血糖。",
    2: "建议在 6 个月内复查血压、血脂和血糖，并根据结果调整生活方式。",
    3: "建议建立健康记录，并在 3 个月内完成一次随访复查。",
    4: "建议尽快预约医疗机构进行专业评估，并在 1 个月内复查。",
    5: "建议在 2 周内前往医疗机构完成专业评估；这不是急诊判断。",
}
EMERGENCY_WARNING = (
    "如出现持续胸痛、呼吸困难、单侧肢体无力、口角歪斜或言语不清，"
    "请立即拨打 120。"
)
BMI_DEFAULT_RULE = "bmi-weight-management"
BMI_DEFAULT_SOURCE = "项目审核版基础健康管理规则"
GENERAL_RULE = "general-health-maintenance"
GENERAL_TEXT = "继续保持规律作息和适量活动，并定期记录血压、血脂和血糖。"
GENERAL_SOURCE = "项目通用健康管理模板"
DEFAULT_RULE_SOURCE = "本地规则知识库"
FOCUS_PREFIX = "您现在最需要关注的是"
FOCUS_SEPARATOR = "、"
FOCUS_SUFFIX = "。"
FOCUS_NONE = "目前建议以保持健康习惯和定期复查为主。"
MAX_ACTIONS = 3

# Advice used when no rules document is given.
FALLBACK_ADVICE = {
    "hypertension": "建议持续监测血压，并根据医生建议进行血压管理。",
    "cholesterol": "建议减少高脂饮食摄入，增加膳食纤维与优质蛋白。",
    "diabetes": "建议控制精制糖摄入，并规律复查糖代谢相关指标。",
    "smoker": "建议尽快戒烟或持续戒烟，降低心脑血管风险。",
    "alcohol": "建议减少饮酒频率和饮酒量，避免长期饮酒相关风险。",
    "exercise": "建议每周保持规律有氧运动，逐步提高身体活动水平。",
    "bmi": "建议控制体重，优先通过饮食调整和规律运动降低 BMI。",
}
FALLBACK_GUIDANCE = {
    1: "建议保持现有健康管理习惯，每 12 个月复查一次关键指标。",
    2: "建议低盐低脂饮食，每 6 个月复查血压、血脂等指标。",
    3: "建议建立个人健康档案，并每 3 个月完成一次随访复查。",
    4: "建议尽快在医生指导下进行血压、血脂和心脑血管专项评估，每月复查。",
    5: "建议 2 周内前往医疗机构进行全面临床检查并接受专业指导。",
}

# Population report texts.
SCREENING_BASIS = "年龄>=65 且仿真双风险标签至少一项为 1"
RISK_FACTOR_NAMES = {
    "hypertension": "高血压",
    "diabetes": "糖尿病",
    "cholesterol": "血脂异常",
    "smoker": "当前吸烟",
    "bmi": "超重或肥胖",
    "exercise": "缺乏规律运动",
}

# What an assessment says about the scope of its models.
SCOPE_TYPE = "screening_proxy"
SCOPE_LABEL = "心脑血管风险筛查模型"
SCOPE_DISCLAIMER = "结果用于课程项目中的健康风险提示，不代表临床诊断或真实年度发病概率。"
