"""Words that made-up records are put together from, per locale."""

FIRST = {
    "en_US": ["Alice", "Brian", "Carol", "David", "Erin", "Frank"],
    "it_IT": ["Alba", "Bruno", "Carla", "Dario", "Elena", "Fabio"],
    "fr_FR": ["Anne", "Benoît", "Claire", "Denis", "Élise", "François"],
    "de_DE": ["Anja", "Bernd", "Clara", "Dieter", "Eva", "Fritz"],
    "es_ES": ["Ana", "Benito", "Carmen", "Diego", "Elisa", "Félix"],
    "pt_BR": ["Alice", "Bento", "Clara", "Davi", "Elisa", "Fábio"],
    "ja_JP": ["愛", "翔", "結衣", "蓮", "陽菜", "大輔"],
    "zh_CN": ["伟", "芳", "娜", "敏", "静", "强"],
}
LAST = {
    "en_US": ["Adams", "Baker", "Carter", "Dixon", "Ellis", "Foster"],
    "it_IT": ["Amato", "Bianchi", "Conti", "De Luca", "Esposito", "Ferri"],
    "fr_FR": ["Aubert", "Blanc", "Caron", "Dupont", "Étienne", "Faure"],
    "de_DE": ["Albrecht", "Bauer", "Claus", "Dietrich", "Engel", "Fischer"],
    "es_ES": ["Alonso", "Blanco", "Castro", "Díaz", "Espinosa", "Flores"],
    "pt_BR": ["Almeida", "Barros", "Cardoso", "Duarte", "Esteves", "Farias"],
    "ja_JP": ["佐藤", "鈴木", "高橋", "田中", "伊藤", "渡辺"],
    "zh_CN": ["王", "李", "张", "刘", "陈", "杨"],
}
CITY = {
    "en_US": ["Springfield", "Riverton", "Lakewood", "Fairview"],
    "it_IT": ["Roma", "Torino", "Salerno", "Verona"],
    "fr_FR": ["Lyon", "Nantes", "Dijon", "Rennes"],
    "de_DE": ["Bonn", "Kiel", "Ulm", "Mainz"],
    "es_ES": ["Burgos", "León", "Cádiz", "Toledo"],
    "pt_BR": ["Recife", "Natal", "Belém", "Santos"],
    "ja_JP": ["東京", "大阪", "京都", "札幌"],
    "zh_CN": ["北京", "上海", "广州", "成都"],
}
STATE = {
    "en_US": ["Ohio", "Texas", "Oregon"], "it_IT": ["Campania", "Lazio", "Veneto"],
    "fr_FR": ["Bretagne", "Normandie", "Occitanie"], "de_DE": ["Bayern", "Hessen", "Sachsen"],
    "es_ES": ["Galicia", "Aragón", "Murcia"], "pt_BR": ["Bahia", "Ceará", "Paraná"],
    "ja_JP": ["北海道", "大阪府", "福岡県"], "zh_CN": ["广东省", "四川省", "山东省"],
}
STREET = {
    "en_US": "%d %s Street", "it_IT": "Via %2$s %1$d", "fr_FR": "%d rue %s", "de_DE": "%2$sstraße %1$d",
    "es_ES": "Calle %2$s %1$d", "pt_BR": "Rua %2$s, %1$d", "ja_JP": "%2$s%1$d丁目", "zh_CN": "%2$s路%1$d号",
}
PREFIX = {
    "en_US": ["Mr.", "Mrs.", "Dr."], "it_IT": ["Sig.", "Sig.ra", "Dott."], "fr_FR": ["M.", "Mme", "Dr"],
    "de_DE": ["Herr", "Frau", "Dr."], "es_ES": ["Sr.", "Sra.", "Dr."], "pt_BR": ["Sr.", "Sra.", "Dr."],
    "ja_JP": ["様"], "zh_CN": ["先生", "女士"],
}
DIAL = {"en_US": 1, "it_IT": 39, "fr_FR": 33, "de_DE": 49, "es_ES": 34, "pt_BR": 55, "ja_JP": 81, "zh_CN": 86}
SUFFIX = ["Jr.", "Sr.", "II", "III", "PhD"]
COUNTRY = ["Italy", "France", "Germany", "Spain", "Brazil", "Japan", "China", "Canada", "Norway", "Kenya"]
LOGIN = ["amber", "basil", "cedar", "delta", "ember", "fjord", "grove", "heron", "inlet", "juniper"]
DOMAIN = ["example.com", "example.org", "example.net"]
COMPANY_END = ["Ltd", "Group", "Inc", "and Sons"]
JOB = ["Analyst", "Baker", "Chemist", "Designer", "Engineer", "Farmer", "Gardener", "Historian"]
QUALITY = ["Adaptive", "Balanced", "Compact", "Durable", "Efficient", "Flexible"]
MANNER = ["local", "modular", "open", "parallel", "quiet", "robust"]
THING = ["archive", "bridge", "channel", "database", "engine", "framework"]
DOING = ["aggregate", "benchmark", "deliver", "extend", "integrate", "streamline"]
CARD = ["VISA 16 digit", "Mastercard", "American Express", "Discover"]
WORD = [
    "river", "stone", "light", "paper", "table", "garden", "window", "market", "summer", "letter",
    "number", "forest", "bridge", "winter", "animal", "street", "minute", "island", "doctor", "music",
]
