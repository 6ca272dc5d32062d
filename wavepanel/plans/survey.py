"""Fixed values of the household-panel survey the library was written for.

FIXED VALUES — these must equal the original study's dictionaries for the
results to agree; they are data, kept verbatim and in their natural order.
"""

# FIXED VALUES: label given to a multi-answer question answered with no option
# ticked (every slot 'NA').
NONE_LABEL = "Nenhuma opção"
NA = "NA"
YES = "Sim"
NO = "Não"

# FIXED VALUES: race answers -> race category.
RACE_CATEGORIES = {
    "Parda": "Parda",
    "Preta": "Preta",
    "Branca": "Branca",
    "Indigena": "Indígena",
    "Amarela": "Amarela",
    "Amarela (Asiática)": "Amarela",
    "NA": "NA",
    "Não sabe/Não respondeu": "NA",
    "Não sabe": "NA",
}

# FIXED VALUES: yes / no / maybe answers of the four yes-no profile questions.
YES_NO_CATEGORIES = {
    "sim": "Sim",
    "nao": "Não",
    "NA": "NA",
    "talvez": "Sim",
}

# FIXED VALUES: ordinal scale shared by every question whose name starts with
# CATEGORY_PREFIX.
CATEGORY_ORDER = ["NA", "E1", "E2", "P1", "P2", "D"]

# FIXED VALUES: race collapse used by the grouped transitions / descriptive table.
RACE_COLLAPSE = {"Negros e indígenas": ["Parda", "Preta", "Indígena"]}
RACE_COLLAPSE_OTHER = "Brancos e amarelos"

# FIXED VALUES: recode applied to the yes/no profile columns before the
# association matrix.
MAYBE_AS_YES = {"Talvez": "Sim"}

# FIXED VALUES: questions whose answers are lists of ticked assertions (their
# table unit is responses, not families).
MULTI_ANSWER_QUESTIONS = [
    "BathroomQualit",
    "HousingProblems",
    "CommFacilities",
    "Garbage",
    "HealthGenKidsNames",
    "HealthGenNames",
    "Internet",
    "Documents",
    "IncomeDesc",
    "JobSatisfaction",
]

# FIXED VALUES: territories that are renamed.
TERRITORY_RENAMES = {"Boca do Sapo (São Paulo)": "Favela dos Sonhos (São Paulo)"}

# FIXED VALUES: anchor question that decides a family's first and last wave,
# and the minimum first-to-last gap kept (gap > 1).
ANCHOR_QUESTION = "CategoriaIGF"
MIN_GAP = 2

# FIXED VALUES: missing-answer share above which a question is flagged.
NA_THRESHOLD = 50

# FIXED: questions with this prefix have the category scale.
CATEGORY_PREFIX = "Categoria"
