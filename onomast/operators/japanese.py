"""Names in Han characters alone: Chinese or Japanese?

``flags`` are twenty features of the characters.  ``train`` fits a model on
names of both kinds, as a Spark ML pipeline; ``builtin_model`` is one of names
that are made of common surnames and given names of either language.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import among
from ..lexicon import tables

# Characters that speak for either language, by place.
ITERATION = "々"
JP_SURNAME = "田中山本木村井川原藤野池石松竹林森東西北南上下大小高長新古佐"
JP_ENDING = "子美也郎男之哉奈菜里佳香恵愛花夏春秋冬雪月星海空光希未真純清"
CN_ENDING = "华明伟强军平勇杰涛波磊鹏辉刚超飞龙凤霞红玲丽娟芳燕静敏慧兰梅"
JP_UNIQUE = "辺沢浜栄竜礼稲彦蔵衛介助郎丸丞斎斉桜櫻"
CN_SIMPLIFIED = "赵刘陈邓关兰乔许闫贾钱孔白崔康史顾侯邵孟"
CN_FREQUENT = "国民建文志忠义礼智信仁勇才德宝福寿康安宁"
JP_FREQUENT = "雄雅正直克修治和昭博弘宏広寛豊富貴尊敬慶"
CN_SURNAME = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"

# Common Japanese surnames in Han characters, the most common first.
JP_SURNAMES = (
    "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 斎藤 清水 山崎 森 池田 橋本 阿部 石川 山下 中島 石井 小川 前田 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 "
    "青木 坂本 斉藤 福田 太田 西村 藤井 金子 岡本 藤原 中野 三浦 原田 中川 松田 竹内 小野 田村 中山 和田 石田 森田 上田 原 内田 柴田 酒井 宮崎 横山 高木 安藤 宮本 大野 小島 谷口 今井 工藤 高田 増田 丸山 "
    "杉山 村田 大塚 新井 小山 平野 藤本 河野 上野 野口 武田 松井 千葉 菅原 岩崎 久保 木下 佐野 野村 松尾 菊地 市川 杉本 古川 大西 島田 水野 桜井 渡部 吉川 山内 西田 飯田 西川 小松 北村 安田 五十嵐 川口 "
    "平田 関 中田 久保田 服部 岩田 土屋 川崎 福島 本田 辻 樋口 秋山 田口 永井 山中 中西 吉村 川上 石原 大橋 松岡 浜田 馬場 森本 矢野 浅野 松下 星野 大久保 吉岡 小池 野田 荒木 大谷 松浦 熊谷 黒田 堀 尾崎 "
    "望月 永田 岸田 菅野 菅 安倍 内藤 渡邊 渡邉 田辺 山根 片山 早川 須藤 川村 大島 奥村 三宅 栗原 小沢 榎本 岡崎 細川"
).split()
# Common Japanese given names in Han characters.
JP_GIVEN = (
    "太郎 一郎 次郎 三郎 五郎 健一 浩一 誠一 純一 雄一 隆一 慎一 光一 正一 洋一 健太 翔太 雄太 大輔 大介 健介 啓介 俊介 拓也 達也 和也 哲也 直也 卓也 直樹 秀樹 英樹 茂樹 正樹 和夫 一夫 正夫 幸夫 義夫 康男 敏夫 "
    "文夫 正雄 義雄 和雄 秀雄 武雄 忠雄 邦彦 和彦 信彦 克彦 文彦 晴彦 義彦 博之 弘之 裕之 雅之 孝之 和之 正義 義明 義弘 義博 弘光 光博 一博 隆 茂 勝 清 誠 勲 進 修 豊 博 弘 昭 実 稔 勉 聡 剛 亮 翼 蓮 大翔 悠斗 "
    "純一郎 慎太郎 健太郎 龍太郎 幸太郎 虎之助 龍之介 大五郎 花子 愛子 恵子 和子 幸子 洋子 陽子 裕子 智子 純子 京子 節子 弘子 文子 久美子 由美子 恵美子 真理子 美智子 美咲 美香 美穂 美和 美紀 由美 由紀 真由美 直美 明美 里美 "
    "麻美 麻衣 彩 愛 舞 葵 結衣 陽菜 香織 沙織 詩織 理恵 千恵 奈々 菜々子 遥 萌 優花 優子 桜 千尋 晋也 晋平 泰三 泰造 泰之 康之 康弘 安彦 源三 吉雄 相馬 普一"
).split()
# Characters at the head and at the end of Japanese given names of two characters.
JP_HEAD = "正義和秀康泰博文武忠信克晴弘裕雅孝敏幸光友元安久貞重政宗盛良直隆茂清誠健慎浩邦利勝達哲智千美真由奈恵理佳沙早朝相善賢栄寛豊俊純昌恒圭修伸伊春夏秋冬雪"
JP_TAIL = "夫男雄彦之一吉三人也樹司介助蔵作治次郎平美子代江枝香恵織紀行明則範史志広弘宏久徳生太輔哉乃菜奈花音月里穂実信義光博文男偉"
NGRAMS, MIN_DF, MAX_DF, VOCABULARY, REGULARISATION = (1, 2, 3), 3, 0.95, 5000, 0.1


def flags(name: Column) -> dict[str, Column]:
    """The features, as numbers, of a name without spaces."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    any_of = lambda x, chars_: x.rlike(f"[{chars_}]").cast("double")
    first, two, last, rest = F.substring(name, 1, 1), F.substring(name, 1, 2), F.substring(name, F.length(name), F.lit(1)), F.substring(name, F.lit(2), F.length(name))
    share = lambda chars_: F.length(F.regexp_replace(name, f"[^{chars_}]", "")) / n
    code = F.filter(F.transform(chars, lambda c: F.when(c.between("一", "鿿"), F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("double"))), lambda c: c.isNotNull())
    heavy = F.when(F.size(code) > 0, F.aggregate(code, F.lit(0.0), lambda a, c: a + (c - 0x4E00) / (0x9FFF - 0x4E00)) / F.size(code)).otherwise(0.0)
    return {
        "jp_iter_mark": any_of(name, ITERATION),
        "jp_surname_chars": any_of(two, JP_SURNAME),
        "cn_surname_chars": any_of(two, CN_SURNAME),
        "jp_name_endings": any_of(last, JP_ENDING),
        "cn_name_endings": any_of(last, CN_ENDING),
        "jp_unique_chars": any_of(name, JP_UNIQUE),
        "cn_simplified_chars": any_of(name, CN_SIMPLIFIED),
        "len_eq2": (F.length(name) == 2).cast("double"),
        "len_eq3": (F.length(name) == 3).cast("double"),
        "len_ge4": (F.length(name) >= 4).cast("double"),
        "jp_frequent_chars": any_of(name, JP_FREQUENT),
        "cn_frequent_chars": any_of(name, CN_FREQUENT),
        "surname_jp_pattern": any_of(first, JP_SURNAME),
        "surname_cn_pattern": any_of(first, CN_SURNAME),
        "given_jp_pattern": any_of(rest, JP_ENDING),
        "given_cn_pattern": any_of(rest, CN_ENDING),
        "jp_ending_ratio": share(JP_ENDING),
        "cn_ending_ratio": share(CN_ENDING),
        "char_diversity": F.size(F.array_distinct(chars)) / n,
        "avg_char_strokes": heavy,
    }


def labelled(ids: DataFrame) -> DataFrame:
    """(name, label) of made names, one for each id: Japanese ones (1) of even ids, Chinese ones (0) of odd ids.

    ids: (id).  A name is a surname and a given name of common ones; Chinese
    surnames come by their share, and given names have one character or two,
    now and then the same twice; Japanese given names are listed ones, or
    made of two characters.
    """
    pick = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    of = lambda words, i: F.element_at(among(words), i + 1)
    cn_given = tables.GIVEN_CHARACTERS
    ppm = tables.SURNAMES | {s: tables.COMPOUND_SURNAMES[s] for s in fixed_compounds()}
    cn_sur = [s for s, x in ppm.items() for _ in range(max(1, round(x / 1000)))]
    made = F.concat(of(JP_HEAD, pick(10, len(JP_HEAD))), of(JP_TAIL, pick(11, len(JP_TAIL))))
    jp = F.concat(of(JP_SURNAMES, pick(1, len(JP_SURNAMES))), F.when(pick(12, 10) < 4, made).otherwise(of(JP_GIVEN, pick(3, len(JP_GIVEN)))))
    a, b = of(cn_given, pick(7, len(cn_given))), of(cn_given, pick(8, len(cn_given)))
    given = F.when(pick(9, 10) < 3, a).when(pick(9, 10) == 3, F.concat(a, a)).otherwise(F.concat(a, b))
    cn = F.concat(of(cn_sur, pick(5, len(cn_sur))), given)
    even = F.col("id") % 2 == 0
    return ids.select(F.when(even, jp).otherwise(cn).alias("name"), F.when(even, 1.0).otherwise(0.0).alias("label"))


def fixed_compounds() -> tuple[str, ...]:
    """Chinese surnames of two characters among those of the table, which also holds words that aren't."""
    return ("欧阳", "上官", "皇甫", "司马", "诸葛", "司徒", "令狐", "宇文", "呼延", "赫连", "东方", "慕容", "宗政", "濮阳", "夏侯", "闻人")


def featured(names: DataFrame) -> DataFrame:
    """names (name) with the flags, and the characters for n-grams."""
    return names.withColumns({**flags(F.col("name")), "chars": F.filter(F.split("name", ""), lambda c: c != "")})


def train(chinese: DataFrame, japanese: DataFrame, min_df: int = MIN_DF, regularisation: float = REGULARISATION) -> PipelineModel:
    """A pipeline of n-grams weighed by inverse document frequency, brought to length 1, and flags, then logistic regression with balanced classes.

    chinese, japanese: (name) in Han characters alone; repeated names count
    each.  An n-gram counts once in a name.  Null and empty names are left
    out.  An error where one of the kinds is empty.
    """
    both = chinese.select("name").withColumn("label", F.lit(0.0)).unionByName(japanese.select("name").withColumn("label", F.lit(1.0)))
    both = featured(both.where(F.coalesce(F.col("name"), F.lit("")) != "")).persist()
    counts = {r["label"]: r["count"] for r in both.groupBy("label").count().collect()}
    if len(counts) < 2:
        raise ValueError("names of both kinds are needed")
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1.0, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    grams = [NGram(n=n, inputCol="chars", outputCol=f"g{n}") for n in NGRAMS]
    joined = SQLTransformer(statement=f"SELECT *, concat({', '.join(f'g{n}' for n in NGRAMS)}) AS grams FROM __THIS__")
    count = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=VOCABULARY, minDF=min_df, maxDF=MAX_DF, binary=True)
    counted = Pipeline(stages=[*grams, joined, count]).fit(both)
    idf = IDF(inputCol="tf", outputCol="tfidf").fit(counted.transform(both)).idf.toArray()
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf + 1), inputCol="tf", outputCol="tfidf")
    unit = Normalizer(inputCol="tfidf", outputCol="unit")
    pack = VectorAssembler(inputCols=["unit", *flags(F.lit(""))], outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1 / (regularisation * total), standardization=False, maxIter=60, tol=1e-5)
    rest = Pipeline(stages=[weigh, unit, pack, lr]).fit(counted.transform(both).withColumn("weight", weight))
    both.unpersist()
    return PipelineModel([*counted.stages, *rest.stages])


#: Made names that the built-in model is fitted on, and its C: so few rows stand for many more.
BUILTIN_ROWS, BUILTIN_C = 24_000, 20.0
#: A folder for the built-in model: it is loaded from there, or fitted and saved there.
MODEL_KEY = "spark.onomast.japanese.model"
_MODEL: dict[str, PipelineModel] = {}


def builtin_model(spark: SparkSession) -> PipelineModel:
    """The model of made names, fitted or loaded once for an application; see ``MODEL_KEY``."""
    app = spark.sparkContext.applicationId
    if app not in _MODEL:
        _MODEL.clear()
        path = spark.conf.get(MODEL_KEY, None)
        if path and _exists(spark, path):
            _MODEL[app] = load(path)
        else:
            names = labelled(spark.range(0, BUILTIN_ROWS, 1, 2))
            _MODEL[app] = train(names.where("label = 0"), names.where("label = 1"), regularisation=BUILTIN_C)
            if path:
                save(_MODEL[app], path)
    return _MODEL[app]


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def probabilities(model: PipelineModel, names: DataFrame) -> DataFrame:
    """(name, probability) of distinct names by a trained model; null has no row, and an empty name what the flags alone say."""
    return model.transform(featured(names.where("name is not null").select("name").distinct())).select("name", vector_to_array("probability")[1].alias("probability"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
