"""What the registered queries must find, stated as values."""

from __future__ import annotations

# Names and the text that each must give, or none where it must be rejected.
NAMES: dict[str, dict[str, str | None]] = {
    "golden_names": {
        "Chi-Ying F. Huang": "Chi-Ying F Huang",
        "An Li": "An Li", "Chen Linlin": "Lin-Lin Chen", "Han jun": "Jun Han", "Hu Cha": "Cha Hu", "Koo Ming": "Ming Koo",
        "Liu Yuehua": "Yue-Hua Liu", "Wang Nini": "Ni-Ni Wang", "Xiaojuan Han": "Xiao-Juan Han", "Zhang Xuefeng": "Xue-Feng Zhang",
        "Chen Dan": "Dan Chen", "Choi Ka-Fai": "Ka-Fai Choi", "Chunfang Li": "Chun-Fang Li", "DAN SUN": "Dan Sun", "Dan Sun": "Dan Sun",
        "Gao Shan": "Shan Gao", "H M Zhang": "H-M Zhang", "Han Han": "Han Han", "Im Siu-Ming": "Siu-Ming Im", "Jin Bo": "Bo Jin",
        "Juan Song": "Juan Song", "Jung Chi-Wai": "Chi-Wai Jung", "Lee Min": "Min Lee", "Li Weiwei": "Wei-Wei Li", "Lingfeng Wu": "Ling-Feng Wu",
        "Liu Nan": "Nan Liu", "Mo Yan": "Yan Mo", "Ruigang Li": "Rui-Gang Li", "Tianhua Liu": "Tian-Hua Liu", "Wang Li Ming": "Li-Ming Wang",
        "Wenxuan Chen": "Wen-Xuan Chen", "  Zhang  ,  Wei  ": "Wei Zhang", "Ch'en Wei": "Wei Ch'en", "Chen,Mei Ling": "Mei-Ling Chen",
        "JinHua": "Hua Jin", "Li.Wei.Zhang": "Li-Wei Zhang", "LuWANG": "Lu Wang", "P.Y. Huang": "P-Y Huang", "Wang B.": "B Wang", "Wu M.J.": "M-J Wu",
        "X. F. Han": "X-F Han", "XIAO-JUAN LI": "Xiao-Juan Li", "Y. Z. Wei": "Y-Z Wei", "Zeng, Wei": "Wei Zeng",
        "Au-Yeung Ka-Ming": "Ka-Ming Au-Yeung", "Chen, Mei Ling": "Mei-Ling Chen", "Cheng-Hung Huang": "Cheng-Hung Huang",
        "Choi, Suk-Zan": "Suk-Zan Choi", "Li Xiao-Juan": "Xiao-Juan Li", "Liu, Dehua": "De-Hua Liu", "Shu-Juan Li": "Shu-Juan Li",
        "Wong, Siu Ming": "Siu-Ming Wong", "Xiao-Hong Li": "Xiao-Hong Li", "Xiaohong Li": "Xiao-Hong Li", "Yu-Zhong Wei": "Yu-Zhong Wei",
        "Zeng Wei": "Wei Zeng", "Yuan Li": "Yuan Li", "Ming Ou": "Ming Ou", "Xiao-Yu Jin": "Xiao-Yu Jin", "Miao Jian-Wei": "Jian-Wei Miao",
        "Xiao-Wei Zhai": "Xiao-Wei Zhai", "Wen Xiao-Jun": "Xiao-Jun Wen", "Yuan Jing-Wei": "Jing-Wei Yuan", "Zhai Hong-Yu": "Hong-Yu Zhai",
        "Li Guan Long": "Guan-Long Li", "Cao Chang Qi": "Chang-Qi Cao", "Yuan Zhang Ming": "Zhang-Ming Yuan", "Zhang Ri Long": "Ri-Long Zhang",
        "Yu He Ming": "He-Ming Yu", "Wu Yi Wen": "Yi-Wen Wu", "Li Xing Gang": "Xing-Gang Li", "Zhao Jiang Hui": "Jiang-Hui Zhao",
        "Wang Jin Zhong": "Jin-Zhong Wang", "Yang Qian Hua": "Qian-Hua Yang", "Chen Si Qi": "Si-Qi Chen", "Gao Xin": "Xin Gao",
        "Wei Shao Fen": "Shao-Fen Wei", "Wang Yuan Qing": "Yuan-Qing Wang", "Liu Shi Song": "Shi-Song Liu", "bin han": "Bin Han",
        "jian zhang": "Jian Zhang", "ling ma": "Ling Ma", "Chan Tai Man": "Tai-Man Chan", "Fung Hiu Man": "Hiu-Man Fung",
        "Lam Ching Ying": "Ching-Ying Lam", "Leung Chiu Wai": "Chiu-Wai Leung", "Szeto Wai Kin": "Wai-Kin Szeto", "Tse Ting Fung": "Ting-Fung Tse",
    },
    "golden_compound": {
        "Duanmu Wenjie": "Wen-Jie Duanmu", "DUANMU wenjie": "Wen-Jie Duanmu", "sima xiangru": "Xiang-Ru Sima", "au yeung chun": "Chun Au Yeung",
        "Ou Yang Wei Ming": "Wei-Ming Ou Yang", "Si Ma Qian Feng": "Qian-Feng Si Ma", "AU-YEUNG chun": "Chun Au-Yeung",
        "Si-Ma Qian Feng": "Qian-Feng Si-Ma", "OuYang Wei Ming": "Wei-Ming OuYang", "auyeung ka ming": "Ka-Ming Auyeung", "AuYeung Li": "Li AuYeung",
        "Au-Yeung Li": "Li Au-Yeung", "aUyEUNG ka ming": "Ka-Ming AuYeung", "au yeung ka ming": "Ka-Ming Au Yeung",
        "Au-Yeung Ka Ming": "Ka-Ming Au-Yeung", "AU-YEUNG ka ming": "Ka-Ming Au-Yeung", "Au-Yeung Chun": "Chun Au-Yeung",
        "Jiangzhou Wang": "Jiang-Zhou Wang", "Jianying Zhou": "Jian-Ying Zhou", "Li Zeze": "Ze-Ze Li", "Ouyang Xiu": "Xiu Ouyang",
        "Sun Xiao-long": "Xiao-Long Sun",
    },
    "golden_han": {
        "巩俐": "Li Gong", "李伟": "Wei Li", "王明": "Ming Wang", "张华": "Hua Zhang", "刘强": "Qiang Liu", "陈静": "Jing Chen", "杨红": "Hong Yang",
        "赵敏": "Min Zhao", "李王": "Wang Li", "张李": "Li Zhang", "陈杨": "Yang Chen", "孔子": "Zi Kong", "孟子": "Zi Meng", "老子": "Zi Lao",
        "欧阳明": "Ming Ou Yang", "司马华": "Hua Si Ma", "诸葛": "Ge Zhu", "林林": "Lin Lin", "华华": "Hua Hua", "明李": "Ming Li", "华王伟": "Wang-Wei Hua",
        "張偉": "Wei Zhang", "劉強": "Qiang Liu", "增友  叶": "Zeng-You Ye", "李明华": "Ming-Hua Li", "王小明": "Xiao-Ming Wang", "张三": "San Zhang", "李四": "Si Li",
        "王五": "Wu Wang", "赵六": "Liu Zhao",
    },
    "golden_mixed": {
        "Chü Chen": "Chu Chen", "Li Yü": "Yu Li", "Lü Buwei": "Bu-Wei Lu", "Wei-min Zhang 张为民": "Wei-Min Zhang", "Xiaohong Li 张小红": "Xiao-Hong Li",
        "Yü Li": "Yu Li", "Yü Ying-shih": "Ying-Shih Yu", "Zhou（Mary）Li": "Li Zhou", "刘（Thomas）Wang": "Liu Wang",
        "张为民 Wei-min Zhang": "Wei-Min Zhang", "李（Peter）Chen": "Li Chen", "贺娟 He Juan": "Juan He", "陈丹 Chen Dan": "Dan Chen",
        "陈（David）Liu": "Chen Liu",
    },
    "golden_rejected": {
        "Bruce Lee": None, "Kwang-Hwi Cho": None, "Lee Young-ho": None, "Hwang Kyu-tae": None, "Bae Eun-jeong": None, "Kim Woo-bin": None,
        "Namgoong Min": None, "Lee Sung-kyung": None, "Kim Myung-soo": None, "Tran Minh Tuan": None, "Adrian Liu": None, "Clara Wong": None,
        "Seung-Hyun Lee": None, "Joon-Ho Ryu": None, "Choi In-Soo": None, "Kang Tae-Hyun": None, "Ana Martinez": None, "Hanna Jones": None,
        "Diane Davis": None, "Dean Johnson": None, "Mike Smith": None, "Kang Young-ho": None, "Andrew Chen": None, "Nguyen Van Hai": None,
        "Tanaka Hanako": None, "山田太郎": None, "藤原愛子": None, "田中健一": None, "高橋美咲": None, "加藤浩一": None, "中村美香": None, "橋本太郎": None,
    },
}

# surnames' shares per million, with those that follow from a target.
SURNAME_PPM = {
    "王": 68479.7, "wang": 68479.7, "zhang": 62799.6, "chen": 35080.8, "feng": 5305.3, "li": 63038.1, "lee": 63038.1, "leung": 5594.9, "欧阳": 745.1,
    "tsai": 4177.0, "chiang": 4028.0, "kuo": 10798.0,
}

# Readings that a surname's usual reading lends its share.
ALIAS_PPM = {"zeng": 3793.8, "yuan": 4504.8, "ou": 817.5, "jin": 3214.7, "lai": 63038.1, "miao": 736.6, "zhai": 1021.9, "mo": 1779.8, "wen": 2422.7}

# Of the made names' tokens, those that are surnames and their shares.
TOKEN_PPM = {
    "wong": 68479.7, "zhang": 62799.6, "lin": 8149.6, "zheng": 7762.1, "chen": 35080.8, "wu": 16077.8, "liu": 45525.4, "huang": 15698.8,
    "jing": 60.0, "ying": 60.0, "lu": 3206.2, "tsai": 4177.0, "wei": 4564.5, "lan": 647.2, "yang": 26347.8, "hong": 1328.5, "li": 63038.1,
    "wang": 68479.7, "leung": 5594.9, "zhao": 19288.3, "tsui": 13395.3, "hsieh": 5522.5, "mei": 774.9, "hsu": 13395.3, "ng": 16077.8, "chan": 35080.8,
    "min": 60.0, "ouyang": 464.1048, "zhou": 16312.0, "ma": 10815.0, "gao": 9444.0, "hao": 2316.3, "szeto": 58.5995, "hua": 647.2,
    "yan": 2754.9, "cheung": 62799.6, "feng": 5305.3,
}

TOKEN_SURNAMES = tuple(TOKEN_PPM)

# Those that are given syllables.
TOKEN_GIVEN = (
    "wong", "zhang", "lin", "zheng", "chen", "wu", "liu", "huang", "jing", "ying", "lu", "tsai", "wei", "lan", "yang", "hong", "li", "wang", "leung",
    "zhao", "tsui", "hsieh", "mei", "hsu", "ng", "chan", "min", "ming", "jun", "zhou", "ma", "gao", "hao", "hua", "yan", "cheung", "feng",
)

# Their syllables.
TOKEN_PARTS = {
    "kafai": "ka|fai", "minjun": "min|jun", "xiaoming": "xiao|ming", "wei": "wei", "chihwei": "chih|wei", "yuchen": "yu|chen", "ming": "ming",
    "ouyang": "ouyang", "xiaohong": "xiao|hong", "soojin": "soo-jin",
}

# Words of the made names that are surnames, where hyphens and apostrophes end a word or not.
SURNAME_WORDS = TOKEN_SURNAMES

# Why a name is rejected.
REASONS = {
    "Joon-Ho Ryu": "Korean-only surname detected",
    "Ana Martinez": "Western name detected",
    "Nguyen Van Hai": "appears to be Vietnamese name",
    "Andrew Chen": "given name tokens are not plausibly Chinese",
    "Lee Young-ho": "Korean structural patterns detected",
    "Kwang-Hwi Cho": "no Chinese evidence found",
    "Tanaka Hanako": "Japanese surname detected",
    "田中健一": "Japanese name detected by ML classifier",
}

# In what order the parts of a name were written.
ROLES = {
    "Ouyang Xiu": "surname given",
    "Xiaohong Li": "given surname",
    "Chi-Ying F. Huang": "given middle surname",
    "明李": "given surname",
    "欧阳明": "surname given",
}
