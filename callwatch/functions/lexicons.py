"""Keyword tables, label synonyms and canned texts.

Order matters throughout: hits are listed in it, and it decides ties.
"""

# Who is speaking.
SHIP_WORDS = ["vts", "报告", "我船", "本船", "申请", "请求", "呼叫", "已靠泊", "已靠港", "已抛锚", "mayday", "求救", "救助", "遇险", "紧急", "需要援助", "准备离泊", "预计靠泊时间", "到达锚地", "通过报告线", "计划抛锚", "请问", "能否", "是否", "询问", "咨询"]
OPERATOR_WORDS = ["vts收到", "收到", "请保持守听", "请待命", "请报告", "请加强瞭望", "等待指令", "按规定", "警告", "指令", "立即", "报告位置", "人员数量", "伤亡情况", "拖轮", "消防船", "救援", "撤离", "禁止", "许可", "允许", "可以", "建议", "前往", "泊位", "锚地", "转换频道", "请注意", "谨慎航行", "限速"]
STRONG_SHIP_WORDS = ["我船", "本船", "申请", "请求", "呼叫", "已靠泊", "已靠港", "已抛锚", "mayday", "求救", "救助", "遇险", "紧急", "需要援助", "准备离泊", "通过报告线", "计划抛锚", "到达锚地"]
SHIP_REPORT_WORDS = ["报告", "通过报告线", "计划抛锚", "申请靠泊", "准备离泊", "到达锚地", "预计靠泊时间", "抛锚完毕", "靠泊完毕", "吃水", "船名", "呼号", "eta", "目的港"]
OPERATOR_INSTRUCTION_WORDS = ["警告", "指令", "立即", "报告位置", "人员数量", "伤亡情况", "火势", "进水", "堵漏", "拖轮", "消防船", "救援", "撤离", "禁止", "保持守听", "许可", "允许", "可以", "建议", "前往", "锚地", "泊位", "等待", "报告动态", "转换频道", "请注意", "谨慎航行", "限速"]
DISTRESS_WORDS = ["遇险", "mayday", "紧急", "需要援助", "求救", "救命", "救助"]

# Scenarios by kind of call.
HIGH_RISK = {
    "collision": ["碰撞", "相撞", "撞上", "撞击"],
    "grounding_or_reef": ["搁浅", "触礁"],
    "fire_or_explosion": ["失火", "着火", "起火", "火灾", "冒烟", "爆炸"],
    "listing_or_capsize": ["倾斜", "横倾", "左倾", "右倾", "倾覆", "翻沉"],
    "flooding_or_sinking": ["进水", "下沉", "沉没", "快沉", "沉没危险"],
    "loss_control_or_mechanical_failure": ["失控", "无法航行", "失去动力", "主机故障", "舵机故障", "机械故障", "需要拖轮"],
    "anchor_dragging": ["走锚", "拖锚"],
    "person_overboard_or_medical": ["人员落水", "伤病", "医疗援助", "人员受伤"],
    "piracy_or_armed_attack": ["海盗", "袭击", "武装袭击"],
    "oil_or_dangerous_cargo_spill": ["溢油", "污染", "危险货物泄漏", "危险货物入海", "泄漏"],
    "aircraft_distress": ["航空器遇险", "飞机遇险", "直升机遇险"],
    "confined_space_trapped": ["密闭舱室", "人员被困", "舱室被困"],
}
NON_HIGH_RISK = {
    "enter_or_leave_vts": ["进入vts", "驶出vts", "进入交管区", "驶出交管区"],
    "berth_or_departure": ["靠泊", "离泊", "靠港", "进港", "出港"],
    "anchoring": ["锚泊", "抛锚", "锚地"],
    "channel_navigation_or_crossing": ["航道航行", "穿越航道", "过报告线", "通过报告线"],
    "traffic_organization_or_avoidance": ["避让", "让清航道", "宽让", "保持距离"],
    "pilot_or_tug_service": ["引航", "拖轮"],
    "weather_hydro_navmark": ["气象", "水文", "航标", "水深", "能见度"],
    "safety_broadcast": ["安全信息", "广播"],
    "water_work_or_drill": ["水工作业", "演习", "试航", "过驳"],
    "violation_correction": ["违章", "纠正", "超速", "逆行", "未报告"],
}
AUTO_REPLY = {
    "berth_completed": ["靠泊完毕", "靠港完毕", "已靠泊", "已靠港", "已靠妥", "系泊"],
    "anchor_completed": ["抛锚完毕", "抛好锚", "已抛锚", "到达锚地", "锚泊"],
    "report_line": ["报告线", "通过报告线", "过报告线"],
    "departure_report": ["离泊报备", "准备离泊", "离泊", "出港"],
    "arrival_plan": ["进入vts", "准备靠港", "预计靠泊时间", "eta", "目的港"],
}
MANUAL_ADVICE = {
    "navmark_depth_weather_query": ["询问", "请问", "能否", "是否", "气象", "水深", "航标", "能见度"],
    "other_ship_dynamics_query": ["他船位置", "他船动态"],
    "drill_trial_lightering": ["申请演习", "演习", "试航", "过驳"],
    "bridge_or_ice_navigation": ["桥区", "冰区"],
    "equipment_fault_not_loss_control": ["设备故障", "信号差", "频道干扰"],
    "routine_avoidance_coordination": ["避让", "让清航道", "宽让", "保持距离"],
}

# Run-time routing groups, in order of precedence.
ROUTING = [
    {
        "level": "L1",
        "event_type": "紧急险情",
        "keywords": ["mayday", "求救", "救命", "进水", "起火", "失火", "着火", "冒烟", "人员落水", "救生筏", "左倾", "倾斜严重", "严重倾斜", "快沉", "沉没"],
        "suggestion": "建议值班员立即人工接管，核实船位、人员和周边态势，并启动最高优先级应急响应流程。",
        "broadcast_text": "相关船舶立即加强瞭望并保持守听，附近应急力量立即做好协助准备。",
        "action_type": "emergency_manual",
        "review": True,
        "auto": False,
    },
    {
        "level": "L2",
        "event_type": "高危疑似场景",
        "keywords": ["碰撞", "搁浅", "失控", "失去动力", "故障", "发生问题", "团雾", "浓雾", "让清航道", "快要碰上", "避让"],
        "suggestion": "建议值班员复核语义和通航态势；若上下文确认存在险情，应升级为人工处置事件。",
        "broadcast_text": "请相关船舶注意当前通航风险，保持安全航速，加强瞭望，按规定避让。",
        "action_type": "risk_manual_review",
        "review": True,
        "auto": False,
    },
    {
        "level": "L3",
        "event_type": "通信或监管异常",
        "keywords": ["未响应", "占频", "逆行", "禁止通行", "闯入", "超速", "未报告"],
        "suggestion": "建议值班员复核通话内容，并视情况进行点名提醒。",
        "broadcast_text": "请相关船舶遵守通航秩序和无线电通信要求，保持守听并及时报告。",
        "action_type": "manual_review",
        "review": True,
        "auto": False,
    },
    {
        "level": "AUTO",
        "event_type": "由动转静常规报告",
        "keywords": ["靠港", "靠泊", "码头", "到泊", "已靠妥", "抛锚", "锚泊", "抛好锚", "过报告线", "报告线", "报告vts", "报告船位"],
        "suggestion": "识别为由动转静的高频标准化报告，可记录信息并按规则生成回复。",
        "broadcast_text": "VTS收到，请保持守听，按计划靠泊或锚泊作业。",
        "action_type": "auto_reply",
        "review": False,
        "auto": True,
    },
    {
        "level": "MANUAL",
        "event_type": "非自动化业务",
        "keywords": ["离泊", "申请离泊", "请求离泊", "出港", "申请出港", "请求开航", "目的地", "航行计划", "天气"],
        "suggestion": "该类业务涉及航行计划、目的地、天气或态势等多因素判断，暂不进入自动回复，由值班员人工处理。",
        "broadcast_text": "VTS收到，请保持守听，等待值班员进一步指令。",
        "action_type": "manual_business",
        "review": True,
        "auto": False,
    },
]
RECHECK_SUGGESTION = "识别置信度低于 0.80，建议先由值班员复核，再决定是否发送标准回复。"
HIT_LINE = "命中关键词: "
LOW_CONFIDENCE_LINE = "识别置信度低于自动化阈值: "
SUMMARY = ("识别到疑似", "，命中关键词：", "。")
FALLBACK_RATIONALE = "规则兜底结果，仅用于冷启动和人工复核排序，不作为最终可靠标签。"

# Keywords that transcripts are tagged with, by path.
KEYWORDS = {
    "upload": ["mayday", "求救", "进水", "起火", "失火", "着火", "冒烟", "救生筏", "左倾", "人员落水", "碰撞", "搁浅", "失控", "失去动力", "故障", "团雾", "让清航道", "避让", "未响应", "占频", "逆行", "禁止通行", "闯入", "超速", "未报告", "靠港", "靠泊", "抛锚", "报告线", "离泊", "出港"],
    "stream": ["mayday", "求救", "进水", "起火", "失火", "人员落水", "碰撞", "搁浅", "失控", "失去动力", "让清航道", "避让", "未响应", "占频", "逆行", "禁止通行", "闯入", "超速", "未报告"],
    "scripted": ["mayday", "求救", "进水", "起火", "失火", "着火", "冒烟", "救生筏", "左倾", "人员落水", "碰撞", "快要碰撞", "失去动力", "故障", "团雾", "让清航道", "避让", "靠港", "靠泊", "抛锚", "报告线", "离泊", "出港"],
}
KEYWORDS["realtime"] = KEYWORDS["microphone"] = KEYWORDS["stream"]

# Label synonyms; what is in no table has the default.
ROLE_SYNONYMS = {"ship": "ship", "vessel": "ship", "船方": "ship", "船舶": "ship", "operator": "operator", "manager": "operator", "vts": "operator", "管理方": "operator", "值班员": "operator", "mixed": "mixed", "混合": "mixed"}
CRISIS_SYNONYMS = {
    "high": "crisis", "danger": "crisis", "emergency": "crisis", "crisis": "crisis", "高危": "crisis", "危机": "crisis", "险情": "crisis",
    "normal": "non_crisis", "non_high": "non_crisis", "non_crisis": "non_crisis", "routine": "non_crisis", "非高危": "non_crisis", "非危机": "non_crisis",
    "not_target": "not_target",
}
AUTOMATION_SYNONYMS = {
    "manual_immediate": "manual_immediate", "emergency_manual": "manual_immediate", "人工处理": "manual_immediate",
    "auto": "auto_reply", "auto_reply": "auto_reply", "自动化": "auto_reply", "自动回复": "auto_reply",
    "llm": "llm_advice", "llm_advice": "llm_advice", "manual_advice": "llm_advice", "非自动化": "llm_advice",
    "not_target": "not_target",
}
RISK_OF = {"crisis": "high", "non_crisis": "normal", "uncertain": "uncertain", "not_target": "not_target"}
CATEGORY_OF = {"crisis": "high_risk", "non_crisis": "non_high_risk", "uncertain": "non_high_risk", "not_target": "not_target"}
CRISIS_OF = {v: k for k, v in RISK_OF.items()}

# Texts of the desk, as (pattern, text) pairs; the last is the default.
AUTO_REPLIES = [("抛锚|锚泊", "VTS收到，锚泊信息已记录，请保持守听并按规定报告后续动态。"), ("靠泊|靠港|码头|直接进去", "VTS收到，靠泊信息已记录，请保持守听，如计划变化请及时补充报告。"), (None, "VTS收到，常规动态转静态报告已记录，请保持守听。")]
MANUAL_ADVICES = [("离泊|出港|开航|申请", "建议人工核实离泊条件、周边态势和当前通航窗口后，再决定是否同意。"), ("碰撞|失控|故障|搁浅", "建议人工立即核实 AIS 与通航态势，必要时点名相关船舶并发出避让提醒。"), (None, "建议值班员复核船名、位置、业务动作和当前通航态势后，再给出正式回复。")]
MANUAL_REASON = "未命中高危或自动回复条件"
MISSING_RESULT = "external_csv 中未找到对应 segment_id/clip_path"
SHIP_MARK, AREA_MARK = "{船名}", "{区域}"
AREA_WORDS = ["段", "区", "主航道"]

# Lexicon rules for lack of a file.
LEXICON = [("锦龙008", ["锦华662", "金堂南", "96008"]), ("警花662", ["警官六六", "警花六六"]), ("北仑主航道A3段", ["主航道A3", "A3段"]), ("172号泊位", ["16 172号泊位", "一七二号泊位"])]

#: The punctuation that comparisons of transcripts ignore, as a character class.
PUNCTUATION = r"\s,，.。:：;；!?！？、\"'“”‘’（）()\[\]【】{}<>《》\-_/\\|~`^"
#: Rewrites before error rates are taken.
RADIO_WORDS = [("频道", "ch"), ("幺", "一"), ("两", "二")]

# What cleaning takes out of transcripts, and the scripts that are flagged.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2700}-\x{27BF}\x{1F1E6}-\x{1F1FF}]+"
BRACKET_TAG = r"[(\[{（【][^)\]}）】]{0,12}[)\]}）】]"
BLANKS_BETWEEN_CJK = r"(?U)(?<=[\x{4e00}-\x{9fff}])\s+(?=[\x{4e00}-\x{9fff}])"
DECORATION = r"[~`^_=<>|\\/]+"
HEADING_MARKS = r"[#*]{2,}"
SCRIPTS = {"japanese_kana": r"[\x{3040}-\x{30ff}]", "korean_hangul": r"[\x{ac00}-\x{d7af}\x{1100}-\x{11ff}\x{3130}-\x{318f}]"}
