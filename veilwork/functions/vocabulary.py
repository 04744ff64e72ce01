"""Entity types and word lists of bank calls."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Entity:
    """An entity type: replacement token, rank among types, risk 1 to 5, whether its tokens are numbered, description."""

    name: str
    token: str
    priority: int
    risk: int
    description: str
    numbered: bool = False


ENTITIES: dict[str, Entity] = {
    e.name: e
    for e in (
        Entity("TW_CREDIT_CARD", "[CARD]", 100, 5, "信用卡號", numbered=True),
        Entity("PERSON", "[NAME]", 95, 4, "姓名", numbered=True),
        Entity("TW_BANK_ACCOUNT", "[ACCOUNT]", 90, 5, "銀行帳號", numbered=True),
        Entity("TW_PHONE", "[PHONE]", 88, 4, "電話號碼"),
        Entity("TW_ID_NUMBER", "[ID]", 85, 5, "身分證字號"),
        Entity("PASSPORT", "[PASSPORT]", 83, 4, "護照號碼"),
        Entity("EMAIL_ADDRESS", "[EMAIL]", 82, 4, "電子郵件"),
        Entity("DOB", "[DOB]", 80, 4, "出生日期"),
        Entity("LOCATION", "[ADDRESS]", 78, 3, "地址/位置"),
        Entity("OTP", "[OTP]", 75, 5, "OTP驗證碼"),
        Entity("LOAN_REF", "[LOAN_REF]", 72, 3, "貸款合約號", numbered=True),
        Entity("EXPIRY", "[EXPIRY]", 70, 4, "信用卡有效期限"),
        Entity("TXN_REF", "[TXN_REF]", 68, 2, "交易流水號", numbered=True),
        Entity("ATM_REF", "[ATM_REF]", 66, 2, "ATM交易序號", numbered=True),
        Entity("PIN", "[PIN]", 65, 5, "PIN密碼"),
        Entity("POLICY_NO", "[POLICY_NO]", 64, 2, "保單號"),
        Entity("STAFF_ID", "[STAFF_ID]", 62, 2, "員工編號"),
        Entity("CVV", "[CVV]", 60, 5, "CVV安全碼"),
        Entity("VERIFICATION_ANSWER", "[VERIFICATION_ANSWER]", 58, 4, "驗證答案"),
        Entity("AMOUNT_TXN", "[AMOUNT_TXN]", 55, 3, "高風險交易金額"),
        Entity("AMOUNT", "[AMOUNT]", 50, 3, "交易金額（條件式）"),
        Entity("CAMPAIGN", "[CAMPAIGN]", 30, 1, "行銷專案代碼"),
        Entity("BRANCH", "[BRANCH]", 25, 1, "分行代碼"),
    )
}
NUMBERED = frozenset(e.name for e in ENTITIES.values() if e.numbered)
TRIGGERS = ("TW_BANK_ACCOUNT", "TW_CREDIT_CARD")
#: What a named-entity model's tags become; other tags are dropped.
NER_TAGS = {"PERSON": "PERSON", "GPE": "LOCATION", "LOC": "LOCATION"}
NER_SCORE = 0.85

_PAY = "轉帳 匯款 扣款 刷卡 付款 繳費 提款 存款"
_BOOK = "匯入 撥款 退款 退費 交易 扣繳 扣除 入帳 出帳"
VERBS = (*_PAY.split(), *_BOOK.split())

#: Words near a match that raise its score; the first of a list that is there is the one that counts.
WORDS: dict[str, tuple[str, ...]] = {
    name: tuple(words.split())
    for name, words in {
        "phone": "電話 手機 市話 聯絡 號碼 撥打 回撥 致電 phone mobile",
        "id": "身分證 身份證 證號 ID 字號",
        "card": "卡號 信用卡 卡 刷卡 card credit",
        "account": "帳號 帳戶 轉帳 匯款 存款 account acct",
        "otp": "驗證碼 一次性密碼 OTP 簡訊碼 認證碼 動態密碼",
        "cvv": "背面三碼 安全碼 CVV CVC 末三碼",
        "expiry": "有效期限 到期 效期 expiry expiration valid",
        "pin": "密碼 PIN 網銀密碼 提款密碼 交易密碼",
        "dob": "生日 出生 生年月日 birthday birth 出生日期",
        "staff": "工號 員工編號 行員 客服代號 staff employee",
        "passport": "護照 passport",
        "loan": "貸款 合約號 借款 loan 合約",
        "txn": "交易 流水號 序號 transaction txn ref",
        "atm": "ATM 交易序號 自動提款 參考號碼",
        "campaign": "活動 專案 行銷 campaign promo",
        "policy": "保單 保險單 policy 投保",
        "branch": "分行 分行代碼 branch 分店",
        "email": "email e-mail 信箱 電子郵件 郵件 mail",
    }.items()
} | {"amount": (*"元 塊 錢 金額 餘額 NT NTD".split(), *VERBS)}
SECURITY_WORDS = tuple("母親 媽媽 驗證問題 安全問題 母親姓名 母親生日".split())

#: Cities, counties and quarters, by their last character.
PLACES = tuple(
    [f"{x}市" for x in "嘉義 台中 台北 台南 基隆 新北 新竹 桃園 臺中 臺北 臺南 高雄".split()]
    + [f"{x}縣" for x in "南投 台東 嘉義 宜蘭 屏東 彰化 新竹 澎湖 臺東 花蓮 苗栗 連江 金門 雲林".split()]
    + "三峽 三民 三重 中和 中壢 五股 八德 前鎮 北屯 南屯".split()
    + "土城 大溪 大里 太平 小港 左營 平鎮 新店 新莊 板橋".split()
    + "林口 楊梅 樹林 永和 汐止 泰山 淡水 苓雅 蘆洲 西屯 霧峰 鳳山 鶯歌".split()
)
CHAINS = tuple("Costco IKEA SOGO costco ikea sogo 全聯 台鐵 大潤發 太平洋 好市多 家樂福 微風".split() + "愛買 捷運 摩斯漢堡 新光三越 星巴克 漢神 統一阪急 肯德基 路易莎 遠東百貨 頂好 高鐵 麥當勞".split())
SITES = tuple("國小 國中 高中 大學 醫院 診所 公園 廟 宮".split() + "捷運站 火車站 高鐵站 客運站 機場 夜市 市場 商圈 購物中心 廣場".split())
NEAR = tuple("附近 旁邊 對面 隔壁 那邊 這邊 一帶".split())
