"""Schemas, code lists, ordered label lists, default cut-offs and weights."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values. These must equal the analysed workload's values for results
# to match; they are stated here once, in natural order.
# --------------------------------------------------------------------------

Q1_COLS = ["Q1_1", "Q1_2", "Q1_3", "Q1_4", "Q1_5", "Q1_6", "Q1_7", "Q1_8", "Q1_9"]
Q2_COLS = ["Q2_1", "Q2_2", "Q2_3", "Q2_4", "Q2_5", "Q2_6", "Q2_7", "Q2_8", "Q2_9"]

# Diagnosis code -> label
DIAGNOSIS_LABELS = {0: "No ADHD", 1: "Inattentive Type", 2: "Hyperactive Type", 3: "Combined Type"}
DX_ORDER = ["No ADHD", "Inattentive Type", "Hyperactive Type", "Combined Type"]

# Gender code -> label
GENDER_LABELS = {1: "Male", 2: "Female"}

# Family history text -> ordinal code
FAMILY_HISTORY_CODES = {"No": 0, "Yes": 1, "Unknown": 2}

# Life stage (inclusive age ranges). SQL labels and notebook labels.
LIFE_STAGES = [(3, 4, "Early Childhood (3-4)"), (5, 14, "Pediatric (5-14)"),
               (15, 18, "Adolescent (15-18)"), (19, 55, "Adult (19-55)")]
LIFE_STAGES_SHORT = [(3, 4, "Early Childhood"), (5, 14, "Pediatric"),
                     (15, 18, "Adolescent")]
LIFE_STAGE_SHORT_ELSE = "Adult"
STAGE_ORDER = ["Early Childhood", "Pediatric", "Adolescent", "Adult"]

# Pediatric age bands (inclusive)
AGE_BANDS = [(5, 6, "5-6 Early"), (7, 8, "7-8 Young"), (9, 10, "9-10 Mid"),
             (11, 12, "11-12 Pre-Teen"), (13, 14, "13-14 Teen")]
AGE_BAND_ELSE = "Other"

# Flags: sleep < 7, phone > 4, anxiety >= 3, walking < 1, caffeine >= 3
SLEEP_RISK_BELOW = 7
HIGH_SCREEN_ABOVE = 4
ANXIETY_RISK_AT_LEAST = 3
LOW_ACTIVITY_BELOW = 1
HIGH_CAFFEINE_AT_LEAST = 3

# Sleep buckets: upper bounds (exclusive) and labels, last is the rest
SLEEP_BUCKETS = [(6, "Under 6hrs (Severe Sleep Risk)"), (7, "6-7hrs (Mild Sleep Risk)"),
                 (9, "7-9hrs (Normal)")]
SLEEP_BUCKET_ELSE = "Over 9hrs"

# Screen-time buckets: upper bounds (exclusive) and labels, last is the rest
SCREEN_BUCKETS = [(2, "Low (<2hrs)"), (4, "Moderate (2-4hrs)"), (6, "High (4-6hrs)")]
SCREEN_BUCKET_ELSE = "Very High (6+ hrs)"

# Severity classes: inclusive upper bounds and labels, last is the rest
SEVERITY_CLASSES = [(9, "Minimal"), (22, "Mild"), (36, "Moderate")]
SEVERITY_CLASS_ELSE = "Severe"
SEV_ORDER = ["Minimal", "Mild", "Moderate", "Severe"]

# Rule-based risk categories (from the three SQL flags), in report order
RISK_RULE_ORDER = ["Critical Risk", "High Risk", "Moderate Risk", "Low Risk"]

# Quantile-cut risk categories (notebook): cut points and labels
RISK_QUANTILES = [0.33, 0.66]
RISK_QUANTILE_LABELS = ["Low Risk", "Moderate Risk", "High Risk"]

# Composite risk score weights
RISK_WEIGHTS = {"Total_Severity": 0.40, "Anxiety_Risk": 3.0, "Sleep_Risk": 2.5,
                "High_Screen": 2.0, "Low_Activity": 1.5, "High_Caffeine": 1.0}
DOMINANCE_EPS = 0.001

# Outlier rule: |z| > 2
OUTLIER_Z = 2.0

# Column lists of the notebook
LIFESTYLE_VARS = ["Sleep_Hours", "Daily_Phone_Usage_Hours", "Daily_Walking_Running_Hours",
                  "Daily_Coffee_Tea_Consumption", "Anxiety_Depression_Levels", "Focus_Score_Video"]
CORR_COLS = ["Age", "Sleep_Hours", "Daily_Phone_Usage_Hours", "Daily_Walking_Running_Hours",
             "Daily_Coffee_Tea_Consumption", "Focus_Score_Video", "Anxiety_Depression_Levels",
             "Learning_Difficulties", "Difficulty_Organizing_Tasks", "Daily_Activity_Hours",
             "Diagnosis_Class"]
KRUSKAL_VARS = ["Sleep_Hours", "Daily_Phone_Usage_Hours", "Daily_Walking_Running_Hours",
                "Anxiety_Depression_Levels", "Focus_Score_Video", "Daily_Coffee_Tea_Consumption"]
STAT_COLS = ["Hyperactivity_Index", "Inattention_Index", "Total_Severity", "Sleep_Hours",
             "Daily_Phone_Usage_Hours", "Anxiety_Depression_Levels"]
MEAN_SD_METRICS = ["Hyperactivity_Index", "Inattention_Index", "Risk_Score"]
FEATURE_COLS = ["Age", "Gender", "Sleep_Hours", "Daily_Phone_Usage_Hours",
                "Daily_Walking_Running_Hours", "Daily_Activity_Hours",
                "Daily_Coffee_Tea_Consumption", "Anxiety_Depression_Levels", "Focus_Score_Video",
                "Learning_Difficulties", "Difficulty_Organizing_Tasks", "Hyperactivity_Index",
                "Inattention_Index", "Total_Severity", "HI_Dominance_Ratio", "Score_Imbalance",
                "Risk_Score", "Sleep_Risk", "High_Screen", "Anxiety_Risk", "Low_Activity",
                "Family_History_Enc"]
ENGINEERED_FEATURES = ["Hyperactivity_Index", "Inattention_Index", "Total_Severity",
                       "HI_Dominance_Ratio", "Score_Imbalance", "Risk_Score", "Sleep_Risk",
                       "High_Screen", "Anxiety_Risk", "Low_Activity"]
EXPORT_COLS = ["Age", "Gender_Label", "Educational_Level", "Family_History", "Sleep_Hours",
               "Daily_Phone_Usage_Hours", "Daily_Walking_Running_Hours",
               "Daily_Coffee_Tea_Consumption", "Anxiety_Depression_Levels", "Focus_Score_Video",
               "Learning_Difficulties", "Difficulty_Organizing_Tasks", "Hyperactivity_Index",
               "Inattention_Index", "Total_Severity", "HI_Dominance_Ratio", "Score_Imbalance",
               "Risk_Score", "Sleep_Risk", "High_Screen", "Anxiety_Risk", "Life_Stage",
               "Age_Band", "Severity_Class", "Risk_Category", "Diagnosis_Class",
               "Diagnosis_Label"]

# Model settings
SPLIT_TEST_FRACTION = 0.2
SEED = 42
MAX_BINS = 256  # split candidates per feature; covers every value of the score features
CV_FOLDS = 5
RF_TREES, RF_DEPTH, RF_MIN_LEAF = 200, 15, 5
GBT_ROUNDS, GBT_DEPTH, GBT_STEP = 100, 3, 0.1
LR_MAX_ITER = 500
SIGNIFICANCE = 0.05
# --------------------------------------------------------------------------

_D, _I, _S = T.DoubleType(), T.IntegerType(), T.StringType()

# The questionnaire file: 32 columns in file order (the surrogate id is not in the file).
CSV_FIELDS = (
    [("Age", _D), ("Gender", _I), ("Educational_Level", _S), ("Family_History", _S),
     ("Sleep_Hours", _D), ("Daily_Activity_Hours", _D)]
    + [(c, _I) for c in Q1_COLS] + [(c, _I) for c in Q2_COLS]
    + [("Diagnosis_Class", _I), ("Daily_Phone_Usage_Hours", _D),
       ("Daily_Walking_Running_Hours", _D), ("Difficulty_Organizing_Tasks", _I),
       ("Focus_Score_Video", _D), ("Daily_Coffee_Tea_Consumption", _D),
       ("Learning_Difficulties", _I), ("Anxiety_Depression_Levels", _I)]
)
CSV_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in CSV_FIELDS])

# The raw patient table: surrogate id + the 32 file columns.
RAW_SCHEMA = T.StructType([T.StructField("id", T.LongType(), False)] + list(CSV_SCHEMA.fields))
RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]

CLEAN_COLUMNS = ["id", "Age", "Gender", "Educational_Level", "Family_History", "Sleep_Hours",
                 "Daily_Activity_Hours", "Hyperactivity_Index", "Inattention_Index",
                 "Total_Severity", "Diagnosis_Label", "Diagnosis_Class", "Life_Stage", "Age_Band",
                 "Daily_Phone_Usage_Hours", "Daily_Walking_Running_Hours",
                 "Difficulty_Organizing_Tasks", "Focus_Score_Video",
                 "Daily_Coffee_Tea_Consumption", "Learning_Difficulties",
                 "Anxiety_Depression_Levels", "Sleep_Risk_Flag", "High_Screen_Flag",
                 "Anxiety_Risk_Flag"]
