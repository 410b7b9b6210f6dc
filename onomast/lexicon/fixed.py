"""Fixed values of the domain: word lists and spelling tables that results depend on."""

from __future__ import annotations

# Spellings that keep a reading of their own.
EXCEPTIONS = {
    "chen": "chen", "chao": "chao", "cheng": "cheng", "chou": "chou", "fan": "fan", "fu": "fu", "hui": "hui", "kang": "kang", "kao": "kao",
    "ling": "ling", "ma": "ma", "mei": "mei", "ming": "ming", "ning": "ning", "peng": "peng", "shun": "shun", "wang": "wang", "wu": "wu",
    "yang": "yang", "ying": "ying", "yu": "yu", "jeung": "zhang", "leuhng": "liang", "cheung": "zhang", "yeung": "yang", "yew": "yu", "kwan": "guan",
}

# Cantonese surname spelling and its pinyin.
CANTONESE_SURNAME_RULES = {
    "tse": "xie", "chan": "chen", "wong": "wang", "leung": "liang", "chow": "zhou", "ng": "wu", "lam": "lin", "tsang": "zeng", "tang": "tang",
    "yip": "ye", "mak": "mai", "fung": "feng", "siu": "xiao", "lo": "luo", "poon": "pan", "chu": "zhu", "yuen": "yuan", "tsui": "xu", "au": "ou",
    "kam": "jin", "yiu": "yao", "kwong": "kuang", "tam": "tan", "wan": "wen", "pang": "peng", "kong": "jiang", "hsu": "xu", "shum": "cen",
    "fong": "fang", "choi": "cai", "chiu": "zhao", "woo": "hu", "ip": "ye", "luk": "lu", "lai": "lai", "ching": "cheng", "sin": "xian", "kot": "ge",
    "tong": "tang", "teo": "zhang", "goh": "wu", "khoo": "qiu",
}

# Cantonese syllable and its pinyin.
CANTONESE_PHONETIC_RULES = {
    "wai": "wei", "man": "wen", "yin": "yan", "yee": "yi", "fai": "hui", "wing": "rong", "kit": "jie", "hei": "xi", "chi": "zhi", "yat": "ri",
    "hon": "han", "kin": "jian", "tim": "tian", "sing": "xing", "tung": "dong", "hung": "hong", "pui": "pei", "yim": "yan", "yuk": "yu",
    "hiu": "xiao", "kei": "qi", "kui": "gui", "kwai": "gui", "cheuk": "zhuo", "tak": "de", "hak": "ke", "tai": "da", "lun": "lun", "bun": "bin",
    "pun": "pan", "hau": "hou", "kau": "jiu", "sau": "shou", "tau": "tao", "wun": "huan", "kai": "kai", "hoi": "hai", "ngai": "ai", "tsz": "zi",
    "chit": "zhe", "lit": "lie", "yit": "yi", "git": "ji", "mit": "mie", "mut": "mo", "fut": "fu", "wut": "huo", "shut": "shu", "put": "po",
    "tut": "tuo", "lut": "lu", "nut": "nuo", "hok": "xue", "pok": "bo", "kok": "ge", "mok": "mo", "dok": "duo", "tok": "tuo", "fook": "fu",
    "tsuen": "quan", "kuen": "juan", "shuen": "xuan", "heung": "xiang", "keung": "qiang", "yeuk": "yue", "sheuk": "shuo", "leuk": "le", "beuk": "bi",
    "ngok": "e", "tsok": "zuo", "kwok": "guo", "shok": "shuo", "wok": "huo", "wah": "hua", "tat": "da", "yau": "you", "fat": "fa", "yun": "yun",
    "shek": "shi", "tsin": "qian", "chuen": "quan", "on": "an", "hin": "xian", "ho": "he", "to": "du", "ah": "a", "hay": "xi", "kay": "qi",
    "may": "mei", "pay": "pei", "say": "xi", "tay": "dai", "way": "wei", "yay": "yi", "fay": "hui", "hang": "heng", "sang": "sheng", "mang": "meng",
    "nang": "neng", "bang": "beng", "sheung": "shang", "gun": "guan", "got": "ge", "mun": "men", "muk": "mu", "wat": "yu", "aak": "e", "aang": "ang",
    "aat": "a", "aau": "ao", "aai": "ai", "aan": "an", "aam": "an", "aap": "a", "eek": "i", "eeng": "ing", "eet": "i", "eeu": "iao", "eei": "ei",
    "een": "ian", "eem": "ian", "eep": "ie", "iik": "i", "iing": "ing", "iit": "i", "iiu": "iu", "iin": "in", "iim": "in", "iip": "i", "ook": "u",
    "oong": "ong", "oot": "u", "oou": "ou", "oon": "un", "oom": "un", "oop": "u", "uuk": "u", "uung": "ong", "uut": "u", "uun": "un", "uum": "un",
    "uup": "u",
}

# Taiwanese spelling and its pinyin.
TAIWANESE_RULES = {
    "chia": "jia", "chien": "jian", "chieh": "jie", "chin": "jin", "chine": "qin", "ching": "jing", "chih": "zhi", "chun": "jun", "chung": "zhong",
    "hsien": "xian", "hsiao": "xiao", "hsin": "xin", "hsiu": "xiu", "hsu": "xu", "kuang": "guang", "kuan": "guan", "kung": "gong", "pei": "bei",
    "teng": "deng", "ting": "ding", "tiong": "tang", "tsung": "zong", "tsai": "cai", "jen": "ren", "jui": "rui", "pao": "bao", "tsao": "cao",
    "jyh": "zhi", "horng": "hong", "shyang": "xiang", "miin": "min", "huey": "hui", "chew": "zhou", "wun": "wen", "jeng": "zheng", "tzong": "zong",
    "yau": "yao", "hsieh": "xie",
}

# Spelling and pinyin that count before those of the other tables.
GIVEN_TOKEN_RULES = {
    "shing": "cheng", "lok": "luo", "pak": "bai", "tou": "du", "tso": "cao", "yan": "yan", "yung": "rong", "kut": "qu", "seung": "song", "chee": "qi", "hean": "xian",
}

# Wade-Giles syllable and its pinyin.
WADE_GILES_SYLLABLES = {
    "chuang": "zhuang", "chuai": "zhuai", "chuan": "zhuan", "chueh": "jue", "chui": "zhui", "tsu": "cu", "tsi": "ci", "tsa": "ca", "tzu": "zi",
    "szu": "si", "ko": "ge", "hsia": "xia", "hsi": "xi", "chü": "ju", "yü": "yu", "lü": "lu", "lüe": "lue", "nü": "nu", "shih": "shi", "kuan": "guan",
    "pa": "ba", "po": "bo", "pu": "bu", "pi": "bi", "piao": "biao", "pien": "bian", "ping": "bing", "ta": "da", "te": "de", "ti": "di",
    "tiao": "diao", "tien": "dian", "tu": "du", "tuan": "duan", "tui": "dui", "tun": "dun", "tuo": "duo", "ka": "ga", "kai": "gai", "kan": "gan",
    "ke": "ge", "ken": "gen", "keng": "geng", "kou": "gou", "ku": "gu", "kua": "gua", "kuai": "guai", "kuei": "gui", "kun": "gun", "kuo": "guo",
    "erh": "er", "ih": "i", "uo": "o",
}

# Unaspirated letters.
ONE_LETTER = {
    "p": "b", "t": "d", "k": "g",
}

# Cantonese, Hokkien and Korean surname spelling and its pinyin.
CANTONESE_SURNAMES = {
    "chan": "chen", "wong": "wang", "lee": "li", "lau": "liu", "cheung": "zhang", "chow": "zhou", "ng": "wu", "leung": "liang", "ho": "he",
    "kwok": "guo", "lam": "lin", "yeung": "yang", "cheng": "zheng", "tsang": "zeng", "tang": "tang", "ma": "ma", "mak": "mai", "fung": "feng",
    "siu": "xiao", "lo": "luo", "poon": "pan", "kwan": "guan", "chu": "zhu", "yuen": "yuan", "tsui": "xu", "tse": "xie", "au": "ou", "kam": "jin",
    "yiu": "yao", "szeto": "situ", "au yeung": "ou yang", "kwong": "kuang", "tam": "tan", "pang": "peng", "kong": "jiang", "hsu": "xu", "shum": "cen",
    "fong": "fang", "choi": "cai", "chiu": "zhao", "woo": "hu", "ip": "ye", "luk": "lu", "fan": "fan", "lai": "lai", "ching": "cheng", "sin": "xian",
    "kot": "ge", "tong": "tang", "li": "li", "chang": "zhang", "huang": "huang", "tsoi": "cai", "hui": "xu", "mok": "mo", "sit": "xue", "pun": "pan",
    "lung": "long", "tin": "tian", "lok": "luo", "miu": "miao", "suen": "sun", "chak": "zhai", "tiu": "zhao", "kiu": "qiao", "tso": "cao",
    "fok": "huo", "pak": "bai", "loi": "lei", "chik": "qi", "sik": "shi", "yik": "yi", "wai": "wei", "yan": "yan", "koo": "gu", "kut": "qu",
    "cheuk": "zhuo", "yam": "ren", "mo": "mo", "ning": "ning", "ngai": "ai", "wu": "wu", "yung": "rong", "shiu": "shao", "tat": "da", "seung": "song",
    "so": "su", "tou": "du", "yau": "you", "yu": "yu", "yip": "ye", "wan": "wen", "sze": "shi", "shing": "cheng", "shek": "shi", "jung": "zheng",
    "han": "han", "lim": "lin", "im": "lin", "teo": "zhang", "goh": "wu", "khoo": "qiu", "soo": "su", "jang": "zhang", "shin": "shen", "moon": "wen",
    "suh": "xu", "son": "sun", "kyeong": "jing",
}

# Compound surname as written and its pinyin.
COMPOUND_VARIANTS = {
    "au yeung": "ou yang", "auyeung": "ou yang", "szeto": "si tu", "sima": "si ma", "cheung sun": "zhang sun", "wong sun": "wang sun",
    "lee sun": "li sun", "chan sun": "chen sun", "wong fu": "huang fu", "sheung gun": "shang guan", "chu gar": "zhu ge", "ha hau": "xia hou",
    "seem toh": "shen tu", "sze kung": "si kong", "sze kau": "si kou", "taam toi": "tan tai", "man yan": "wen ren", "mo kei": "mo qi",
    "see mun": "xi men", "seen yu": "xian yu", "yuen suen": "xuan yuan", "yue chi": "yu chi", "yue man": "yu wen", "o yeung": "ou yang",
    "szto": "si tu", "see ma": "si ma", "ouyang": "ou yang", "shangguan": "shang guan", "zhuge": "zhu ge", "xiahou": "xia hou", "huangfu": "huang fu",
    "situ": "si tu", "murong": "mu rong", "dongfang": "dong fang", "gongsun": "gong sun", "linghu": "ling hu", "nangong": "nan gong",
    "weichi": "wei chi", "zhongli": "zhong li", "diwu": "di wu", "duanmu": "duan mu", "dongguo": "dong guo", "helian": "he lian", "huyan": "hu yan",
    "liangqiu": "liang qiu", "gongyang": "gong yang", "zuoqiu": "zuo qiu", "tuoba": "tuo ba", "yuchi": "yu chi", "changsun": "zhang sun",
    "zhangsun": "zhang sun", "tokoh": "du gu", "dugu": "du gu", "yuwen": "yu wen", "pugu": "pu gu", "puyang": "pu yang", "taishi": "tai shi",
    "gongxi": "gong xi", "zaisang": "zai sang", "baili": "bai li", "wuma": "wu ma", "yangsi": "yang si", "lezheng": "le zheng", "gongbo": "gong bo",
    "tangtai": "tang tai",
}

# Usual reading of a surname's character and its reading as a surname.
PINYIN_ALIASES = {
    "ceng": "zeng", "ruan": "yuan", "qu": "ou", "gan": "jin", "li": "lai", "mou": "miao", "di": "zhai", "mao": "mo", "yin": "wen",
}

# Onsets; the empty one is added..
ONSETS = (
    "b", "p", "m", "f", "d", "t", "n", "l", "g", "k", "h", "j", "q", "x", "zh", "ch", "sh", "r", "z", "c", "s", "y", "w",
)

# Rimes..
RIMES = (
    "a", "e", "i", "o", "u", "ü", "ai", "ei", "ao", "ou", "ia", "ie", "iao", "iu", "ua", "ui", "uo", "üe", "an", "en", "in", "un", "ün", "ian", "uan",
    "üan", "ang", "eng", "ing", "ong", "iang", "uang", "iong", "er", "uk", "ok", "ik", "ak", "ek", "oi", "au", "eu", "ee", "eek",
)

# Syllables that are given names beyond doubt..
ANCHORS = (
    "wei", "jing", "li", "ming", "hui", "yan", "yu", "xiao", "jun", "hong", "hua", "jie", "ping", "fang", "ying", "lan", "na", "qiang", "min", "lin",
    "bin", "bo", "chen", "cheng", "chun", "dan", "dong", "feng", "gang", "guo", "hai", "hao", "jian", "jia", "jin", "kai", "kun", "lei", "liang",
    "ling", "long", "mei", "peng", "qian", "qing", "ran", "rong", "rui", "shan", "sheng", "tao", "ting", "wen", "xiang", "xin", "xiu", "xue", "yang",
    "yi", "yong", "zhen", "zhi", "zhong", "zhu",
)

# Korean surnames that are not Chinese.
KOREAN_ONLY = (
    "kim", "gim", "park", "bark", "bag", "yoon", "seo", "kwon", "gwon", "hwang", "ahn", "yoo", "jeon", "baek", "heo", "nam", "shim", "noh", "joo",
    "bae", "ryu", "ku", "won", "ryoo", "yeo", "pyo", "oh", "go", "roh",
)

# Korean given syllables.
KOREAN_GIVEN = (
    "soo", "hyun", "hee", "young", "ram", "min", "jun", "seok", "woo", "jin", "ho", "sung", "hoon", "joon", "won", "bin", "han", "sik", "tae", "jae",
    "kyung", "myung", "dong", "sang", "sub", "sup", "chul", "bora", "boram", "haneul", "areum", "seul", "seulgi", "byeol", "hana", "nuri", "kyu",
    "hye", "ji", "su", "ae", "eun", "seong", "kyun", "bum", "ki", "woong", "jung", "bo", "seung", "gi", "sol", "bit", "dal", "eum", "byul", "saem",
    "nae", "rae", "wol", "seon", "hyeon", "gook", "seob", "yeol", "yung", "yun",
)

# Korean given syllables that are not Chinese.
KOREAN_SPECIFIC = (
    "soo", "hyun", "hee", "young", "ram", "seok", "woo", "hoon", "joon", "won", "sik", "tae", "jae", "kyung", "myung", "sub", "sup", "chul", "bora",
    "boram", "haneul", "areum", "seul", "seulgi", "byeol", "hana", "nuri", "kyu", "hye", "su", "ae", "eun", "seong", "kyun", "bum", "ki", "woong",
    "bo", "seung", "gi", "sol", "bit", "dal", "eum", "byul", "saem", "nae", "rae", "wol", "seon", "hyeon", "gook", "seob", "yeol",
)

# Given syllables of both.
KOREAN_AMBIGUOUS = (
    "min", "jun", "jin", "ho", "sung", "bin", "han", "dong", "sang", "jung", "ji", "yung", "yun",
)

# Pairs of Korean given syllables.
KOREAN_PAIRS = (
    ("soo", "jin"), ("min", "soo"), ("min", "jung"), ("soo", "jung"), ("heung", "min"), ("ye", "jin"), ("ha", "young"), ("ji", "min"), ("hoon", "ki"),
    ("young", "ho"), ("hyun", "woo"), ("seung", "hyun"), ("min", "jae"), ("jin", "woo"), ("sung", "ho"), ("tae", "hyun"), ("dong", "hyun"),
    ("sang", "woo"), ("kyung", "ho"), ("myung", "soo"), ("jae", "hyun"), ("won", "ho"), ("bin", "na"), ("hye", "jin"), ("eun", "ji"),
)

# Surnames of both Koreans and Chinese.
KOREAN_OVERLAP = (
    "lee", "choi", "jung", "jeong", "lim", "im", "han", "cho", "jo", "song", "ho", "na", "gong", "koo", "kang", "an", "ha", "cha", "suh", "son",
    "soo", "jang", "shin", "moon", "kyeong",
)

# Vietnamese surnames that are not Chinese.
VIETNAMESE_ONLY = (
    "nguyen", "truong", "trinh", "dinh", "nguyễn", "trương", "trịnh", "đinh",
)

# Surnames of both Vietnamese and Chinese.
VIETNAMESE_OVERLAP = (
    "tran", "le", "pham", "hoang", "phan", "vu", "vo", "dang", "bui", "do", "ho", "ngo", "duong", "ly", "lê", "phạm", "hoàng", "vũ", "võ", "đặng",
    "bùi", "đỗ", "hồ", "ngô", "dương", "lý",
)

# Japanese surnames.
JAPANESE = (
    "abe", "ando", "aoki", "arashiro", "ashiri", "chinen", "endo", "fujii", "fujikawa", "fujimori", "fujimoto", "fujimura", "fujinaga", "fujinami",
    "fujino", "fujisaki", "fujisawa", "fujishima", "fujita", "fujiwara", "fujiyama", "fukuda", "fukushima", "goto", "gushiken", "hamada", "hamaguchi",
    "hamamoto", "hara", "harada", "haraguchi", "haramoto", "hasegawa", "hashimoto", "hayashi", "higa", "higaonna", "higashida", "higashino",
    "higashiyama", "honda", "hoshino", "ikeda", "inoue", "ishida", "ishii", "ishikawa", "ito", "itou", "kaneko", "kanna", "kato", "kawabata",
    "kawagoe", "kawaguchi", "kawahara", "kawai", "kawamoto", "kawamura", "kawano", "kawasaki", "kawashima", "kikuchi", "kimura", "kinjo", "kishi",
    "kitagawa", "kitahara", "kitamura", "kitano", "kobayashi", "kojima", "kondo", "kubo", "kubota", "kudo", "kuroda", "kushima", "maeda", "maruyama",
    "matsubara", "matsuda", "matsui", "matsumoto", "matsunaga", "matsuo", "matsushita", "matsuyama", "minamino", "minamiyama", "miura", "miya",
    "miyagi", "miyahara", "miyake", "miyamoto", "miyata", "miyazaki", "miyazawa", "miyoshi", "mori", "morikawa", "morimoto", "morimura", "morita",
    "moriyama", "murakami", "nagasawa", "nakagawa", "nakajima", "nakama", "nakamoto", "nakamura", "nakano", "nakata", "nakayama", "nakazato", "nako",
    "nibutani", "nishida", "nishikawa", "nishimura", "nishiyama", "nojima", "oda", "ogawa", "ogino", "ogura", "okabe", "okada", "okamoto", "okamura",
    "okano", "okubo", "ono", "osaka", "oshima", "ota", "otani", "saito", "saitou", "sakai", "sakamoto", "sakata", "sasaki", "sato", "satou", "sawada",
    "sawamura", "sawano", "seki", "sekiguchi", "sekimoto", "shibata", "shima", "shimabukuro", "shimizu", "shimomura", "shiraoi", "shiro", "shirota",
    "shiroyama", "sugiyama", "suzuki", "suzukii", "taira", "tajima", "takada", "takagi", "takahashi", "takahata", "takamura", "takano", "takayama",
    "takeda", "takemoto", "takeuchi", "tamashiro", "tanaka", "tanigawa", "taniguchi", "tojima", "tsuda", "uchida", "uchiyama", "ueda", "uemoto",
    "uemura", "watanabe", "yamada", "yamagata", "yamaguchi", "yamaguti", "yamamoto", "yamanaka", "yamane", "yamasaka", "yamasaki", "yamashiro",
    "yamashita", "yamauchi", "yamazaki", "yasuda", "yogi", "yokomura", "yokoyama", "yoshida", "yoshijima", "yoshikawa", "yoshimoto", "yoshimura",
    "yoshino", "yoshizawa",
)

# Vietnamese given syllables.
VIETNAMESE_GIVEN = (
    "anh", "duc", "minh", "thu", "lan", "mai", "hoa", "hong", "linh", "yen", "van", "thi", "cong", "thanh", "tuyet", "xuan", "quynh", "thuy", "huong",
    "dung", "hien", "tuong", "quan", "khanh", "thang", "dat", "nam", "bao", "hai", "son", "long", "tuan", "ngoc", "trang", "phuong", "cuong", "quoc",
    "thao", "trung", "hieu", "hung", "binh", "vinh", "huy", "phong", "hoai", "khang", "thinh", "duy", "tin", "nghia", "tai", "phuc", "an", "he",
    "cam", "chinh", "cuc", "dieu", "giang", "hiep", "kiet", "lam", "loc", "my", "nhan", "oanh", "qui", "sang", "toan", "uyen", "vuong",
)

# Common Chinese surnames for routing.
PRIOR_CHINESE = (
    "bai", "bi", "cai", "cao", "chen", "cheng", "chong", "chou", "dai", "deng", "ding", "dong", "du", "duan", "fan", "fang", "feng", "fu", "gao",
    "gu", "guo", "han", "he", "hou", "hu", "huang", "jia", "jiang", "jiao", "jin", "kan", "kong", "lee", "lei", "li", "liang", "liao", "lin", "liu",
    "long", "lu", "luo", "ma", "meng", "pan", "peng", "qian", "qin", "qiu", "ren", "shao", "sha", "shen", "shi", "song", "su", "sun", "tan", "tang",
    "tian", "tong", "wang", "wei", "wu", "xiao", "xie", "xu", "xue", "yan", "yang", "yao", "ye", "yin", "yu", "yuan", "zeng", "zhang", "zhao",
    "zheng", "zhou", "zhu",
)

# Korean surnames for routing.
PRIOR_KOREAN = (
    "ahn", "an", "bae", "baek", "cha", "chang", "cho", "choi", "chung", "go", "han", "hong", "hwang", "jang", "jeon", "jeong", "jo", "jung", "kang",
    "kim", "ko", "kwon", "lee", "lim", "moon", "oh", "paik", "pak", "park", "ryu", "seo", "shin", "sim", "song", "suh", "yang", "yim", "yoo", "yoon",
    "yu", "yun",
)

# Korean given syllables for routing.
PRIOR_KOREAN_GIVEN = (
    "ae", "bin", "bo", "chan", "cheol", "chul", "dae", "dong", "eun", "gi", "ha", "hae", "han", "hee", "ho", "hong", "hoon", "hun", "hwan", "hye",
    "hyun", "hyung", "il", "jae", "jin", "jong", "joon", "jun", "jung", "ki", "kyu", "kyung", "kyeong", "min", "sang", "seok", "seong", "seung",
    "sik", "soo", "su", "suk", "sun", "sung", "tae", "uk", "woo", "won", "yeon", "yong", "young", "yun",
)

# Cantonese and South-East Asian surnames for routing.
PRIOR_CANTONESE = (
    "chan", "chang", "chew", "chia", "chong", "chung", "fong", "ho", "hong", "khoo", "lai", "lee", "leong", "leung", "lim", "lin", "low", "ng", "ong",
    "pak", "pang", "tan", "teoh", "tiong", "wong", "yap", "yeo", "yong",
)

# Cantonese given syllables for routing.
PRIOR_CANTONESE_GIVEN = (
    "boon", "chih", "ching", "chiu", "guan", "hee", "hong", "kai", "ke", "kwan", "ling", "man", "mei", "meng", "mun", "pei", "peng", "ping", "seng",
    "siau", "sin", "sook", "sze", "wai", "wan", "wei", "wen", "yee", "yong", "yu", "yue",
)

# Letter clusters that no Chinese syllable has..
FORBIDDEN = (
    "th", "ry", "rd", "str", "scr", "spr", "spl", "shr", "thr", "ck", "dge", "nk", "mp", "nt", "nd", "ft", "pt", "xt", "dr", "br", "fr", "gr", "pr",
    "tr", "cl", "fl", "gl", "pl", "sl", "sm", "sn", "st", "sk", "sp", "bb", "cc", "dd", "ff", "gg", "hh", "jj", "kk", "ll", "mm", "nn", "pp", "qq",
    "rr", "ss", "tt", "vv", "ww", "xx", "yy", "zz", "ea", "oo", "aw", "ow", "drew", "thew", "newt", "stew", "witt", "well", "owell", "ty", "sy", "my",
    "py", "by", "fy", "vy", "wy", "tion", "sion",
)

# Western given names.
WESTERN = (
    "julian", "vivian", "adrian", "christian", "sebastian", "damian", "brian", "ryan", "alan", "susan", "urban", "logan", "jordan", "morgan", "megan",
    "began", "ana", "diana", "lana", "tina", "nina", "anna", "gina", "vera", "sara", "mira", "nora", "hanna", "sina", "kina", "rita", "beta", "meta",
    "delta", "dena", "lena", "sena", "anne", "diane", "june", "wayne", "zina", "channa", "jenna", "genie", "julie", "milan", "liam", "adam", "noah",
    "dean", "sean", "ivan", "ethan", "duncan", "leon", "sage", "karen", "lisa", "linda", "kate", "mike", "eli", "wade", "heidi", "ian", "ben", "tim",
    "tom", "ray", "roy", "jay", "guy", "leo", "joe", "may", "kay", "kim", "amy", "ann", "eva", "lou", "pat", "sue", "val", "wes", "zoe",
)

# Wade-Giles and Taiwanese surname spellings that carry their surname's whole share.
TAIWANESE_SURNAMES = {
    "tsai": "cai", "tsao": "cao", "tseng": "zeng", "chou": "zhou", "chiang": "jiang", "kuo": "guo", "hsieh": "xie", "hsiung": "xiong", "yeh": "ye", "teng": "deng",
    "chien": "qian", "chin": "jin", "chia": "jia", "tuan": "duan", "ting": "ding", "chuang": "zhuang",
}

# Spellings of the Cantonese table that Koreans use far more.
KOREAN_DOMINANT = ("im", "jung", "kyeong", "moon", "pak")

# Characters that are read otherwise as surnames.
SURNAME_READINGS = {"隗": "kui"}
