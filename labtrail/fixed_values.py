"""Vocabularies, lookup tables, patterns and thresholds.

Everything in this module is a value that has to be equal to the published
behaviour for results to agree.  Order matters in every table: where several
entries could apply, the first one listed wins.  No logic lives here.
"""

from __future__ import annotations


# --- fixed values: canonical categories and their priority -----------------
CATEGORY_PRIORITY = {
    "Haematology": 10,
    "Lipid Profile": 10,
    "Liver Function": 10,
    "Kidney Function": 10,
    "Diabetes & Glucose": 10,
    "Thyroid Function": 10,
    "Vitamins & Minerals": 10,
    "Hormones": 10,
    "Cardiac Markers": 10,
    "Immunology": 10,
    "Urinalysis": 10,
    "Inflammation": 10,
    "Proteins": 5,
    "Other": 1,
}

INGEST_STATUSES = ["Low", "Normal", "High", "Critical", "Positive", "Negative", "N/A"]

# --- fixed values: raw category -> canonical category ----------------------
CATEGORY_MAP = [
    ("vitamin b-12", "Vitamins & Minerals"),
    ("vitamin b12", "Vitamins & Minerals"),
    ("vitamin d", "Vitamins & Minerals"),
    ("vitamin levels", "Vitamins & Minerals"),
    ("vitamin profile", "Vitamins & Minerals"),
    ("vitamins", "Vitamins & Minerals"),
    ("minerals", "Vitamins & Minerals"),
    ("iron profile", "Vitamins & Minerals"),
    ("iron studies", "Vitamins & Minerals"),
    ("calcium", "Vitamins & Minerals"),
    ("diabetes", "Diabetes & Glucose"),
    ("diabetes panel", "Diabetes & Glucose"),
    ("glucose metabolism", "Diabetes & Glucose"),
    ("blood sugar", "Diabetes & Glucose"),
    ("diabetes / glucose metabolism", "Diabetes & Glucose"),
    ("diabetes markers", "Diabetes & Glucose"),
    ("hba1c", "Diabetes & Glucose"),
    ("liver function test", "Liver Function"),
    ("liver function", "Liver Function"),
    ("lft", "Liver Function"),
    ("hepatic", "Liver Function"),
    ("kidney function test", "Kidney Function"),
    ("kidney function", "Kidney Function"),
    ("renal function", "Kidney Function"),
    ("kft", "Kidney Function"),
    ("renal", "Kidney Function"),
    ("thyroid function test", "Thyroid Function"),
    ("thyroid profile", "Thyroid Function"),
    ("thyroid", "Thyroid Function"),
    ("tft", "Thyroid Function"),
    ("lipid profile", "Lipid Profile"),
    ("lipids", "Lipid Profile"),
    ("cholesterol", "Lipid Profile"),
    ("haematology", "Haematology"),
    ("hematology", "Haematology"),
    ("cbc", "Haematology"),
    ("complete blood count", "Haematology"),
    ("blood count", "Haematology"),
    ("hormone", "Hormones"),
    ("hormones", "Hormones"),
    ("hormone profile", "Hormones"),
    ("sex hormones", "Hormones"),
    ("reproductive hormones", "Hormones"),
    ("cardiac risk markers", "Cardiac Markers"),
    ("cardiac markers", "Cardiac Markers"),
    ("cardiac", "Cardiac Markers"),
    ("heart", "Cardiac Markers"),
    ("inflammation marker", "Inflammation"),
    ("inflammation markers", "Inflammation"),
    ("inflammatory", "Inflammation"),
    ("crp", "Inflammation"),
    ("proteins", "Proteins"),
    ("protein profile", "Proteins"),
    ("immunology", "Immunology"),
    ("immune", "Immunology"),
    ("serology", "Immunology"),
    ("urinalysis", "Urinalysis"),
    ("urine", "Urinalysis"),
    ("urine routine", "Urinalysis"),
    ("urine analysis", "Urinalysis"),
    ("electrolytes", "Kidney Function"),
    ("blood glucose", "Diabetes & Glucose"),
    ("biochemistry", "Other"),
    ("bone health", "Vitamins & Minerals"),
    ("other", "Other"),
]

# --- fixed values: test-name alias -> canonical test name ------------------
TEST_NAME_MAP = [
    ("sgot", "Aspartate Aminotransferase (SGOT/AST)"),
    ("ast", "Aspartate Aminotransferase (SGOT/AST)"),
    ("aspartate aminotransferase", "Aspartate Aminotransferase (SGOT/AST)"),
    ("sgot/ast", "Aspartate Aminotransferase (SGOT/AST)"),
    ("sgpt", "Alanine Aminotransferase (SGPT/ALT)"),
    ("alt", "Alanine Aminotransferase (SGPT/ALT)"),
    ("alanine aminotransferase", "Alanine Aminotransferase (SGPT/ALT)"),
    ("hba1c", "Glycated Haemoglobin (HbA1C)"),
    ("glycated haemoglobin", "Glycated Haemoglobin (HbA1C)"),
    ("haemoglobin a1c", "Glycated Haemoglobin (HbA1C)"),
    ("25-oh vitamin d", "25-OH Vitamin D (Total)"),
    ("25 oh vitamin d", "25-OH Vitamin D (Total)"),
    ("vitamin d total", "25-OH Vitamin D (Total)"),
    ("vitamin d3", "25-OH Vitamin D (Total)"),
    ("cholecalciferol", "25-OH Vitamin D (Total)"),
    ("25 oh cholecalciferol", "25-OH Vitamin D (Total)"),
    ("ldl", "LDL Cholesterol"),
    ("ldl cholesterol", "LDL Cholesterol"),
    ("low density lipoprotein", "LDL Cholesterol"),
    ("hdl", "HDL Cholesterol"),
    ("hdl cholesterol", "HDL Cholesterol"),
    ("high density lipoprotein", "HDL Cholesterol"),
    ("tsh", "Thyroid Stimulating Hormone (TSH)"),
    ("thyroid stimulating hormone", "Thyroid Stimulating Hormone (TSH)"),
    ("t3", "Triiodothyronine (T3)"),
    ("t4", "Thyroxine (T4)"),
    ("free t3", "Free Triiodothyronine (fT3)"),
    ("free t4", "Free Thyroxine (fT4)"),
    ("creatinine", "Serum Creatinine"),
    ("serum creatinine", "Serum Creatinine"),
    ("urea", "Blood Urea Nitrogen (BUN)"),
    ("bun", "Blood Urea Nitrogen (BUN)"),
    ("blood urea nitrogen", "Blood Urea Nitrogen (BUN)"),
    ("vitamin b12", "Vitamin B12 (Cobalamin)"),
    ("vitamin b-12", "Vitamin B12 (Cobalamin)"),
    ("cobalamin", "Vitamin B12 (Cobalamin)"),
    ("cyanocobalamin", "Vitamin B12 (Cobalamin)"),
    ("ferritin", "Serum Ferritin"),
    ("serum ferritin", "Serum Ferritin"),
    ("haemoglobin", "Haemoglobin (Hb)"),
    ("hemoglobin", "Haemoglobin (Hb)"),
    ("hb", "Haemoglobin (Hb)"),
    ("triglycerides", "Triglycerides"),
    ("trigs", "Triglycerides"),
    ("tg", "Triglycerides"),
    ("glucose", "Fasting Blood Glucose"),
    ("fasting glucose", "Fasting Blood Glucose"),
    ("fasting blood sugar", "Fasting Blood Glucose"),
    ("fbs", "Fasting Blood Glucose"),
    ("mean platelet volume", "Mean Platelet Volume (MPV)"),
    ("mpv", "Mean Platelet Volume (MPV)"),
    ("platelet distribution width", "Platelet Distribution Width (PDW)"),
    ("pdw", "Platelet Distribution Width (PDW)"),
    ("rdw", "RDW (RBC Histogram)"),
    ("rdw rbc histogram", "RDW (RBC Histogram)"),
    ("rbc", "Red Blood Cell Count (RBC)"),
    ("red blood cell count", "Red Blood Cell Count (RBC)"),
    ("total rbc", "Red Blood Cell Count (RBC)"),
    ("rbc electrical impedance", "Red Blood Cell Count (RBC)"),
    ("total leucocyte count", "Total WBC Count"),
    ("total leucocytes count", "Total WBC Count"),
    ("total wbc count", "Total WBC Count"),
    ("wbc", "Total WBC Count"),
    ("tlc", "Total WBC Count"),
    ("cholesterol total", "Total Cholesterol"),
    ("cholesterol-total", "Total Cholesterol"),
    ("protein total", "Total Protein"),
    ("proteins total", "Total Protein"),
    ("bilirubin direct", "Bilirubin Direct (Conjugated)"),
    ("bilirubin conjugated", "Bilirubin Direct (Conjugated)"),
    ("malaria parasite", "Malarial Parasite Screen"),
    ("malarial parasite", "Malarial Parasite Screen"),
    ("r a test", "Rheumatoid Factor (RA)"),
    ("rheumatoid factor", "Rheumatoid Factor (RA)"),
    ("rheumatoid factor ra test", "Rheumatoid Factor (RA)"),
    ("hematocrit", "Haematocrit (HCT/PCV)"),
    ("hematocrit (pcv)", "Haematocrit (HCT/PCV)"),
    ("pcv(calc)", "Haematocrit (HCT/PCV)"),
    ("lymphocytes", "Lymphocytes %"),
    ("lymphocyte", "Lymphocytes %"),
    ("lymphocytes percentage", "Lymphocytes %"),
    ("lymphocytes - absolute count", "Lymphocytes (Absolute)"),
    ("lymphocytes-absolute count", "Lymphocytes (Absolute)"),
    ("lymphocytes absolute count", "Lymphocytes (Absolute)"),
    ("neutrophils", "Neutrophils %"),
    ("neutrophil", "Neutrophils %"),
    ("neutrophils percentage", "Neutrophils %"),
    ("neutrophils - absolute count", "Neutrophils (Absolute)"),
    ("neutrophils-absolute count", "Neutrophils (Absolute)"),
    ("neutrophil absolute", "Neutrophils (Absolute)"),
    ("neutrophil (absolute)", "Neutrophils (Absolute)"),
    ("eosinophils", "Eosinophils %"),
    ("eosinophil", "Eosinophils %"),
    ("eosinophils percentage", "Eosinophils %"),
    ("eosinophils - absolute count", "Eosinophils (Absolute)"),
    ("eosinophil (absolute)", "Eosinophils (Absolute)"),
    ("eosinophils-absolute count", "Eosinophils (Absolute)"),
    ("basophils", "Basophils %"),
    ("basophil", "Basophils %"),
    ("basophils percentage", "Basophils %"),
    ("basophils - absolute count", "Basophils (Absolute)"),
    ("basophil (absolute)", "Basophils (Absolute)"),
    ("basophils-absolute count", "Basophils (Absolute)"),
    ("monocytes", "Monocytes %"),
    ("monocytes percentage", "Monocytes %"),
    ("monocytes - absolute count", "Monocytes (Absolute)"),
    ("monocytes absolute", "Monocytes (Absolute)"),
    ("monocytes (absolute)", "Monocytes (Absolute)"),
    ("monocytes-absolute count", "Monocytes (Absolute)"),
    ("band cell", "Band Cells %"),
    ("platelet count", "Platelet Count"),
    ("platelets", "Platelet Count"),
    ("platelet (smear study)", "Platelet Count (Smear)"),
    ("neut/lympho ratio (nlr)", "Neutrophil/Lymphocyte Ratio (NLR)"),
    ("neut/lympho ratio nlr", "Neutrophil/Lymphocyte Ratio (NLR)"),
    ("immature granulocyte percentage", "Immature Granulocytes %"),
    ("immature granulocyte percentage(ig%)", "Immature Granulocytes %"),
    ("immature granulocyte percentage (ig%)", "Immature Granulocytes %"),
    ("immature granulocytes (ig)", "Immature Granulocytes (Absolute)"),
    ("nucleated red blood cells", "Nucleated RBC"),
    ("nucleated red blood cells %", "Nucleated RBC %"),
    ("platelet to large cell ratio (plcr)", "Platelet Large Cell Ratio (PLCR)"),
    ("platelet to large cell ratio plcr", "Platelet Large Cell Ratio (PLCR)"),
    ("plateletcrit (pct)", "Plateletcrit (PCT)"),
    ("plateletcrit pct", "Plateletcrit (PCT)"),
    ("red cell distribution width index (rdwi)", "RDW Index (RDWI)"),
    ("mentzer index", "Mentzer Index"),
    ("mch (calc)", "MCH"),
    ("mean corpuscular haemoglobin", "MCH"),
    ("mchc (calc)", "MCHC"),
    ("mean corp.hemo.conc(mchc)", "MCHC"),
    ("mcv (rbc histogram)", "Mean Corpuscular Volume (MCV)"),
    ("mean corpuscular volume (mcv)", "Mean Corpuscular Volume (MCV)"),
    ("mean corpuscular volume (mcv) ", "Mean Corpuscular Volume (MCV)"),
    ("mean corpuscular volume", "Mean Corpuscular Volume (MCV)"),
    ("albumin", "Albumin"),
    ("albumin - serum", "Albumin"),
    ("albumin serum", "Albumin"),
    ("globulin", "Globulin"),
    ("serum globulin", "Globulin"),
    ("albumin/globulin ratio (a/g ratio)", "Albumin/Globulin Ratio (A/G)"),
    ("albumin/globulin ratio", "Albumin/Globulin Ratio (A/G)"),
    ("a/g ratio", "Albumin/Globulin Ratio (A/G)"),
    ("serum alb/globulin ratio", "Albumin/Globulin Ratio (A/G)"),
    ("alb creat ratio", "Albumin/Creatinine Ratio"),
    ("alkaline phosphatase (alp)", "Alkaline Phosphatase (ALP)"),
    ("alkaline phosphatase", "Alkaline Phosphatase (ALP)"),
    ("gamma glutamyl transferase", "Gamma-Glutamyl Transferase (GGT)"),
    ("gamma glutamyl transferase (ggt)", "Gamma-Glutamyl Transferase (GGT)"),
    ("bilirubin total", "Bilirubin Total"),
    ("bilirubin - total", "Bilirubin Total"),
    ("bilirubin (indirect)", "Bilirubin Indirect"),
    ("bilirubin indirect", "Bilirubin Indirect"),
    ("bilirubin unconjugated", "Bilirubin Indirect"),
    ("calcium", "Calcium"),
    ("iron", "Serum Iron"),
    ("total iron binding capacity (tibc)", "Total Iron Binding Capacity (TIBC)"),
    ("total iron binding capacity", "Total Iron Binding Capacity (TIBC)"),
    ("unsat.iron-binding capacity(uibc)", "Unsaturated Iron-Binding Capacity (UIBC)"),
    ("% transferrin saturation", "Transferrin Saturation %"),
    ("transferrin saturation", "Transferrin Saturation %"),
    ("folate", "Folate (Folic Acid)"),
    ("magnesium", "Magnesium"),
    ("phosphorous", "Phosphorus"),
    ("sodium", "Sodium (Na)"),
    ("potassium", "Potassium (K)"),
    ("chloride", "Chloride (Cl)"),
    ("uric acid", "Uric Acid"),
    ("est. glomerular filtration rate (egfr)", "eGFR (Estimated)"),
    ("microalbuminuria", "Microalbuminuria"),
    ("vldl", "VLDL Cholesterol"),
    ("vldl cholesterol", "VLDL Cholesterol"),
    ("apolipoprotein - a1 (apo-a1)", "Apolipoprotein A1 (Apo-A1)"),
    ("apolipoprotein-a1 apo-a1", "Apolipoprotein A1 (Apo-A1)"),
    ("apolipoprotein - b (apo-b)", "Apolipoprotein B (Apo-B)"),
    ("apolipoprotein-b apo-b", "Apolipoprotein B (Apo-B)"),
    ("apo b / apo a1 ratio (apo b/a1)", "Apo B/A1 Ratio"),
    ("apo b/apo a1 ratio", "Apo B/A1 Ratio"),
    ("apo b/apo a1 ratio apo b/a1", "Apo B/A1 Ratio"),
    ("lipoprotein (a) [lp(a)]", "Lipoprotein (a) [Lp(a)]"),
    ("testosterone", "Testosterone"),
    ("insulin fasting", "Insulin (Fasting)"),
    ("prostate specific antigen (psa)", "PSA (Total)"),
    ("carcino embryonic antigen (cea)", "CEA (Carcinoembryonic Antigen)"),
    ("anti ccp (accp)", "Anti-CCP Antibodies"),
    ("anti nuclear antibodies (ana)", "ANA (Anti-Nuclear Antibodies)"),
    ("high sensitivity c-reactive protein (hs-crp)", "hs-CRP"),
    ("colour", "Urine Colour"),
    ("transparency", "Urine Transparency"),
    ("sp.gravity", "Urine Specific Gravity"),
    ("ph", "Urine pH"),
    ("leucocytes (esterase)", "Leucocyte Esterase (Urine)"),
    ("ketone bodies urine", "Urine Ketones"),
    ("urobilinogen", "Urobilinogen (Urine)"),
    ("nitrite", "Urine Nitrite"),
    ("epithelial cell (urine)", "Epithelial Cells (Urine)"),
    ("crystals (urine)", "Crystals (Urine)"),
    ("cast (urine)", "Casts (Urine)"),
]

# --- fixed values: test name -> category hint ------------------------------
TEST_CATEGORY_HINTS = [
    ("aspartate aminotransferase", "Liver Function"),
    ("sgot/ast", "Liver Function"),
    ("ldl cholesterol", "Lipid Profile"),
    ("total leucocyte count", "Haematology"),
    ("albumin", "Liver Function"),
    ("albumin/globulin ratio", "Liver Function"),
    ("globulin", "Liver Function"),
    ("triglycerides", "Lipid Profile"),
    ("calcium", "Vitamins & Minerals"),
    ("malarial parasite", "Haematology"),
    ("rheumatoid factor", "Immunology"),
]

# --- fixed values: test pairs that must never be merged --------------------
MUST_NOT_MERGE = [
    ("globulin", "albumin/globulin ratio"),
    ("albumin", "albumin/globulin ratio"),
    ("albumin", "alb creat ratio"),
    ("creatinine", "alb creat ratio"),
    ("iron", "total iron binding capacity"),
    ("iron", "transferrin saturation"),
    ("iron", "unsat iron-binding capacity"),
    ("apolipoprotein-a1", "apolipoprotein-b"),
    ("apo-a1", "apo-b"),
    ("apolipoprotein a", "apolipoprotein b"),
    ("bilirubin total", "bilirubin direct"),
    ("bilirubin total", "bilirubin indirect"),
    ("bilirubin total", "bilirubin conjugated"),
    ("bilirubin direct", "bilirubin indirect"),
    ("bilirubin conjugated", "bilirubin unconjugated"),
    ("neutrophils", "neut/lympho ratio"),
    ("neutrophil", "neut/lympho ratio"),
    ("prostate specific antigen", "free psa"),
    ("t3", "t4"),
    ("free t3", "free t4"),
    ("t3", "tsh"),
    ("t4", "tsh"),
]

# --- fixed values: category -> body parts ----------------------------------
BODY_PARTS = [
    ("Haematology", ["Blood", "Bone Marrow"]),
    ("Complete Blood Count", ["Blood"]),
    ("Liver Function Test", ["Liver", "Digestive System"]),
    ("Liver Function", ["Liver", "Digestive System"]),
    ("Kidney Function Test", ["Kidneys", "Urinary System"]),
    ("Kidney Function", ["Kidneys", "Urinary System"]),
    ("Lipid Profile", ["Blood", "Cardiovascular System", "Heart"]),
    ("Thyroid Profile", ["Thyroid", "Endocrine System"]),
    ("Thyroid Function", ["Thyroid", "Endocrine System"]),
    ("Blood Sugar", ["Blood", "Endocrine System", "Metabolism"]),
    ("Diabetes & Glucose", ["Blood", "Endocrine System", "Metabolism"]),
    ("Electrolytes", ["Blood", "Kidneys", "Metabolism"]),
    ("Urinalysis", ["Kidneys", "Urinary System"]),
    ("Cardiac Markers", ["Heart", "Cardiovascular System"]),
    ("Vitamins", ["Blood", "Nutritional Status", "Metabolism"]),
    ("Vitamins & Minerals", ["Blood", "Nutritional Status", "Metabolism"]),
    ("Hormone Profile", ["Endocrine System", "Metabolism"]),
    ("Hormones", ["Endocrine System", "Metabolism"]),
    ("Tumor Markers", ["Multiple Systems"]),
    ("Allergy Profile", ["Immune System", "Blood"]),
    ("Immunology", ["Immune System", "Blood"]),
    ("Coagulation Profile", ["Blood"]),
    ("Infectious Disease", ["Immune System", "Multiple Systems"]),
    ("Bone Profile", ["Bone", "Metabolism"]),
    ("Protein Profile", ["Blood", "Liver", "Nutritional Status"]),
    ("Proteins", ["Blood", "Liver", "Nutritional Status"]),
    ("Metabolic Panel", ["Metabolism", "Multiple Systems"]),
    ("Inflammatory Markers", ["Immune System", "Blood"]),
    ("Inflammation", ["Immune System", "Blood"]),
    ("Other", ["General"]),
]

# --- fixed values: body part -> symbol -------------------------------------
BODY_PART_SYMBOL = {
    "Blood": "\U0001FA78",
    "Bone Marrow": "\U0001F9B4",
    "Liver": "\U0001FAC1",
    "Digestive System": "\ufffd\u80c3",
    "Kidneys": "\U0001FAD8",
    "Urinary System": "\U0001F4A7",
    "Cardiovascular System": "\u2764\ufe0f",
    "Heart": "\u2764\ufe0f",
    "Thyroid": "\U0001F504",
    "Endocrine System": "\u26a1",
    "Multiple Systems": "\U0001F504",
    "Immune System": "\U0001F6E1\ufe0f",
    "Nutritional Status": "\U0001F957",
    "General": "\U0001F4CA",
}
DEFAULT_SYMBOL = "\U0001F4CA"


# --- fixed values: ordered case-insensitive patterns -> standard form ------
TEST_NAME_PATTERNS = [
    ("haemoglobin", "Haemoglobin"),
    ("hgb", "Haemoglobin"),
    ("total leucocyte count", "Total Leucocyte Count"),
    ("tlc", "Total Leucocyte Count"),
    ("white blood cell count", "Total Leucocyte Count"),
    ("wbc", "Total Leucocyte Count"),
    ("platelet count", "Platelet Count"),
    ("rbc count", "Red Blood Cell Count"),
    ("red cell count", "Red Blood Cell Count"),
    ("hematocrit", "Hematocrit"),
    ("hct", "Hematocrit"),
    ("packed cell volume", "Hematocrit"),
    ("pcv", "Hematocrit"),
    ("mcv", "Mean Corpuscular Volume (MCV)"),
    ("mch", "Mean Corpuscular Haemoglobin (MCH)"),
    ("mchc", "Mean Corpuscular Haemoglobin Concentration (MCHC)"),
    ("rdw-cv", "Red Cell Distribution Width - CV (RDW-CV)"),
    ("rdw-sd", "Red Cell Distribution Width - SD (RDW-SD)"),
    ("neutrophils?", "Neutrophils"),
    ("lymphocytes?", "Lymphocytes"),
    ("monocytes?", "Monocytes"),
    ("eosinophils?", "Eosinophils"),
    ("basophils?", "Basophils"),
    ("esr", "Erythrocyte Sedimentation Rate (ESR)"),
    ("total bilirubin", "Bilirubin - Total"),
    ("direct bilirubin", "Bilirubin - Direct"),
    ("indirect bilirubin", "Bilirubin - Indirect"),
    ("sgpt", "Alanine Aminotransferase (SGPT/ALT)"),
    ("alt", "Alanine Aminotransferase (SGPT/ALT)"),
    ("sgot", "Aspartate Aminotransferase (SGOT/AST)"),
    ("ast", "Aspartate Aminotransferase (SGOT/AST)"),
    ("alkaline phosphatase", "Alkaline Phosphatase (ALP)"),
    ("alp", "Alkaline Phosphatase (ALP)"),
    ("total protein", "Protein - Total"),
    ("albumin", "Albumin"),
    ("globulin", "Globulin"),
    ("a/g ratio", "Albumin/Globulin Ratio (A/G Ratio)"),
    ("urea", "Urea"),
    ("blood urea nitrogen", "Blood Urea Nitrogen (BUN)"),
    ("bun", "Blood Urea Nitrogen (BUN)"),
    ("creatinine", "Creatinine"),
    ("uric acid", "Uric Acid"),
    ("total cholesterol", "Cholesterol - Total"),
    ("triglycerides", "Triglycerides"),
    ("hdl cholesterol", "HDL Cholesterol"),
    ("ldl cholesterol", "LDL Cholesterol"),
    ("vldl cholesterol", "VLDL Cholesterol"),
    ("cholesterol/hdl ratio", "Total Cholesterol/HDL Ratio"),
    ("glucose fasting", "Glucose - Fasting"),
    ("fbs", "Glucose - Fasting"),
    ("glucose random", "Glucose - Random"),
    ("rbs", "Glucose - Random"),
    ("hba1c", "Glycated Haemoglobin (HbA1c)"),
    ("tsh", "Thyroid Stimulating Hormone (TSH)"),
    ("total t3", "Total T3"),
    ("total t4", "Total T4"),
    ("free t3", "Free T3 (FT3)"),
    ("ft3", "Free T3 (FT3)"),
    ("free t4", "Free T4 (FT4)"),
    ("ft4", "Free T4 (FT4)"),
]

UNIT_PATTERNS = [
    ("gm/dl", "g/dL"),
    ("g/l", "g/L"),
    ("cells/cumm", "cells/µL"),
    ("/cumm", "/µL"),
    ("thou/cumm", "x10³/µL"),
    (r"10\^3/ul", "x10³/µL"),
    (r"x10\^3/μl", "x10³/µL"),
    ("mill/cumm", "x10⁶/µL"),
    (r"10\^6/ul", "x10⁶/µL"),
    (r"x10\^6/μl", "x10⁶/µL"),
    ("mg/dl", "mg/dL"),
    ("iu/l", "IU/L"),
    ("u/l", "U/L"),
    ("µiu/ml", "µIU/mL"),
    ("ng/dl", "ng/dL"),
    ("pg/ml", "pg/mL"),
    ("%", "%"),
    ("fl", "fL"),
    ("pg", "pg"),
    ("mm/hr", "mm/hr"),
]

STATUS_PATTERNS = [
    ("low", "Low"),
    ("normal", "Normal"),
    ("high", "High"),
    ("critical", "Critical"),
    ("n/a", "N/A"),
    ("not applicable", "N/A"),
    ("within normal limits", "Normal"),
    ("within reference range", "Normal"),
    ("near optimal", "Near Optimal"),
    ("desirable", "Desirable"),
    ("borderline high", "Borderline High"),
]

# --- fixed values: tokens with their own spelling in display names ---------
DISPLAY_TOKENS = {
    "ph": "pH", "sgot": "SGOT", "sgpt": "SGPT", "ast": "AST", "alt": "ALT",
    "tlc": "TLC", "rbc": "RBC", "rdw": "RDW", "mpv": "MPV", "pdw": "PDW",
    "ldl": "LDL", "hdl": "HDL", "vldl": "VLDL", "ra": "RA", "hba1c": "HbA1C",
}

# --- fixed values: health-score weights ------------------------------------
STATUS_WEIGHTS = {
    "Normal": 100, "N/A": 80, "Low": 60, "High": 40,
    "Critical": 10, "Positive": 30, "Negative": 100,
}
OTHER_STATUS_WEIGHT = 70

# --- fixed values: billing words inside lab names --------------------------
BILLING_TERMS = [
    "bill", "billing", "invoice", "receipt", "payment", "charges",
    "collection center", "collection centre",
]
LAB_SEPARATORS = ["-", "|", ",", "(", ")"]

# --- fixed values: words dropped from the end of names when clustering -----
TRAILING_WORDS = [
    "level", "total", "count", "profile", "panel", "test", "assay", "value",
    "concentration",
]
B12_VARIANTS = [
    "Vitamin B-12", "Vitamin B12", "Vitamin B 12",
    "Vitamin B-12 Level", "Vitamin B12 Level", "Vitamin B 12 Level",
    "vitamin b-12", "vitamin b12", "vitamin b 12",
    "vitamin b-12 level", "vitamin b12 level", "vitamin b 12 level",
    "Vitamin B - 12", "Vitamin B - 12 Level",
    "vitamin b - 12", "vitamin b - 12 level",
]
B12_TARGET = "Vitamin B12"

# --- fixed values: tests where a falling value is an improvement -----------
LOWER_IS_BETTER = [
    "ldl", "triglycerides", "glucose", "hba1c", "sgot", "sgpt", "creatinine",
    "urea", "fastingbloodglucose", "glycatedhaemoglobinhba1c",
    "aspartateaminotransferasesgotast", "alanineaminotransferasesgptalt",
    "serumcreatinine", "bloodureanitrogenbun",
]

# --- fixed values: personal titles, as patterns (a dot is any character) ---
NAME_TITLE_PATTERNS = [
    "mr", "mrs", "ms", "dr", "prof", "self", "mr.", "mrs.", "ms.", "dr.", "prof.",
]

# --- fixed values: retrieval vocabulary ------------------------------------
STOP_WORDS = [
    "the", "a", "an", "to", "of", "and", "or", "in", "on", "for", "with", "my", "me", "about",
    "is", "are", "was", "were", "be", "been", "it", "this", "that", "how", "what", "why", "when",
    "should", "could", "would", "do", "does", "did", "please", "explain",
]
INTENT_TERMS = {
    "trend": ["trend", "change", "changed", "improved", "worse", "increased",
              "decreased", "over time", "history"],
    "urgency": ["danger", "dangerous", "urgent", "critical", "worry", "risk", "serious"],
    "action": ["what should i do", "next step", "treatment", "diet", "exercise",
               "lifestyle", "plan"],
}
CONCEPT_EXPANSIONS = {
    "sugar": ["glucose", "glycemic", "hba1c", "diabetes", "prediabetes"],
    "cholesterol": ["ldl", "hdl", "triglycerides", "lipid", "non-hdl"],
    "liver": ["ast", "alt", "sgot", "sgpt", "bilirubin", "alp"],
    "kidney": ["creatinine", "egfr", "renal", "urea", "urate"],
    "thyroid": ["tsh", "free t4", "ft4", "thyroxine"],
    "blood": ["hemoglobin", "platelet", "ferritin", "b12", "cbc"],
    "inflammation": ["crp", "hs-crp", "inflammatory"],
}

# --- fixed values: metric thresholds (ok at, warn at; <= when lower is good)
METRIC_THRESHOLDS = {
    "json_validity": (100.0, 95.0, "min"),
    "pdf_processing_success": (95.0, 90.0, "min"),
    "hallucination_detection": (0.0, 1.0, "max"),
    "api_reliability": (99.0, 97.0, "min"),
    "context_retention": (90.0, 80.0, "min"),
    "extraction_f1": (95.0, 90.0, "min"),
}

# --- fixed values: guideline table -----------------------------------------
# id | category | names | aliases | keywords | related | source | url | level | updated
GUIDELINES = [
    {
        "id": "hba1c-ada-2024",
        "category": "glycemic",
        "names": ["hba1c", "glycated haemoglobin", "glycated hemoglobin"],
        "aliases": ["a1c", "hemoglobin a1c", "glycohemoglobin"],
        "keywords": ["diabetes", "prediabetes", "glycemic control", "average glucose"],
        "related": ["fasting glucose", "postprandial glucose", "insulin", "urine albumin"],
        "source": "American Diabetes Association Standards of Care 2024",
        "url": "https://diabetesjournals.org/care/issue/47/Supplement_1",
        "title": "HbA1C Targets and Diabetes Classification",
        "level": "A",
        "updated": "2024-01",
    },
    {
        "id": "fasting-glucose-ada-2024",
        "category": "glycemic",
        "names": ["fasting plasma glucose", "fasting glucose", "fbs"],
        "aliases": ["fpg", "fasting blood sugar", "fasting sugar"],
        "keywords": ["fasting", "glucose", "prediabetes", "diabetes diagnosis"],
        "related": ["hba1c", "postprandial glucose", "insulin"],
        "source": "American Diabetes Association Standards of Care 2024",
        "url": "https://diabetesjournals.org/care/issue/47/Supplement_1",
        "title": "Fasting Plasma Glucose Diagnostic and Monitoring Ranges",
        "level": "A",
        "updated": "2024-01",
    },
    {
        "id": "vitamin-d-endocrine-2024",
        "category": "vitamins",
        "names": ["25-oh vitamin d", "vitamin d", "25 hydroxy vitamin d"],
        "aliases": ["25(oh)d", "calcidiol", "cholecalciferol status"],
        "keywords": ["deficiency", "bone", "calcium", "muscle weakness", "supplementation"],
        "related": ["calcium", "phosphorus", "alkaline phosphatase", "pth"],
        "source": "Endocrine Society Clinical Practice Guideline 2024",
        "url": "https://www.endocrine.org/clinical-practice-guidelines",
        "title": "Vitamin D Deficiency and Supplementation",
        "level": "B",
        "updated": "2024-06",
    },
    {
        "id": "ldl-aha-2023",
        "category": "lipids",
        "names": ["ldl cholesterol", "ldl", "low density lipoprotein"],
        "aliases": ["ldl-c", "bad cholesterol"],
        "keywords": ["cholesterol", "cardiovascular", "statin", "ascvd", "lipid"],
        "related": ["hdl", "triglycerides", "non-hdl", "total cholesterol"],
        "source": "ACC/AHA Guideline on Management of Blood Cholesterol 2023",
        "url": "https://www.ahajournals.org/doi/10.1161/CIR.0000000000000625",
        "title": "LDL Cholesterol Targets and Risk Stratification",
        "level": "A",
        "updated": "2023-11",
    },
    {
        "id": "hdl-aha-2023",
        "category": "lipids",
        "names": ["hdl cholesterol", "hdl", "high density lipoprotein"],
        "aliases": ["hdl-c", "good cholesterol"],
        "keywords": ["protective", "lipid", "cardiovascular risk"],
        "related": ["ldl", "triglycerides", "non-hdl"],
        "source": "ACC/AHA Guideline on Management of Blood Cholesterol 2023",
        "url": "https://www.ahajournals.org/doi/10.1161/CIR.0000000000000625",
        "title": "HDL Cholesterol in Risk Context",
        "level": "B",
        "updated": "2023-11",
    },
    {
        "id": "triglycerides-aha-2023",
        "category": "lipids",
        "names": ["triglycerides", "tg"],
        "aliases": ["serum triglycerides"],
        "keywords": ["hypertriglyceridemia", "pancreatitis", "metabolic syndrome", "lipid"],
        "related": ["hdl", "ldl", "non-hdl", "fasting glucose"],
        "source": "ACC Expert Consensus Decision Pathway 2023",
        "url": "https://www.jacc.org",
        "title": "Triglyceride Risk Tiers and Management",
        "level": "A",
        "updated": "2023-10",
    },
    {
        "id": "sgot-ast-aasld-2023",
        "category": "liver",
        "names": ["aspartate aminotransferase", "sgot", "ast"],
        "aliases": ["sgot/ast", "ast enzyme"],
        "keywords": ["liver", "enzyme", "hepatitis", "fatty liver", "muscle injury"],
        "related": ["alt", "alp", "bilirubin", "ggt"],
        "source": "AASLD Practice Guidance on Liver Enzymes 2023",
        "url": "https://www.aasld.org/publications/practice-guidelines",
        "title": "AST Elevation Patterns",
        "level": "B",
        "updated": "2023-08",
    },
    {
        "id": "alt-aasld-2023",
        "category": "liver",
        "names": ["alanine aminotransferase", "sgpt", "alt"],
        "aliases": ["sgpt/alt", "alt enzyme"],
        "keywords": ["liver inflammation", "fatty liver", "hepatocellular"],
        "related": ["ast", "alp", "bilirubin", "ggt"],
        "source": "AASLD Practice Guidance on Liver Enzymes 2023",
        "url": "https://www.aasld.org/publications/practice-guidelines",
        "title": "ALT Interpretation and Follow-up",
        "level": "B",
        "updated": "2023-08",
    },
    {
        "id": "creatinine-kdigo-2024",
        "category": "renal",
        "names": ["serum creatinine", "creatinine"],
        "aliases": ["scr", "blood creatinine"],
        "keywords": ["kidney function", "renal", "ckd", "egfr"],
        "related": ["egfr", "urea", "urine albumin", "potassium"],
        "source": "KDIGO CKD Guideline Update 2024",
        "url": "https://kdigo.org/guidelines/",
        "title": "Creatinine as a Kidney Function Marker",
        "level": "A",
        "updated": "2024-02",
    },
    {
        "id": "egfr-kdigo-2024",
        "category": "renal",
        "names": ["egfr", "estimated gfr", "estimated glomerular filtration rate"],
        "aliases": ["gfr", "ckd-epi egfr"],
        "keywords": ["ckd stage", "kidney stage", "renal decline", "albuminuria"],
        "related": ["creatinine", "urine acr", "urea", "potassium"],
        "source": "KDIGO CKD Guideline Update 2024",
        "url": "https://kdigo.org/guidelines/",
        "title": "eGFR Staging and Risk Context",
        "level": "A",
        "updated": "2024-02",
    },
    {
        "id": "tsh-ata-2023",
        "category": "thyroid",
        "names": ["thyroid stimulating hormone", "tsh"],
        "aliases": ["thyrotropin"],
        "keywords": ["hypothyroid", "hyperthyroid", "subclinical", "thyroid"],
        "related": ["free t4", "free t3", "anti-tpo"],
        "source": "American Thyroid Association Guidelines 2023",
        "url": "https://www.thyroid.org/professionals/ata-professional-guidelines",
        "title": "TSH Reference Framework",
        "level": "A",
        "updated": "2023-05",
    },
    {
        "id": "free-t4-ata-2023",
        "category": "thyroid",
        "names": ["free t4", "free thyroxine", "ft4"],
        "aliases": ["thyroxine free"],
        "keywords": ["thyroxine", "overt hypothyroidism", "overt hyperthyroidism"],
        "related": ["tsh", "free t3"],
        "source": "American Thyroid Association Guidelines 2023",
        "url": "https://www.thyroid.org/professionals/ata-professional-guidelines",
        "title": "Free T4 Confirmation Layer for Thyroid Status",
        "level": "B",
        "updated": "2023-05",
    },
    {
        "id": "hemoglobin-who-2024",
        "category": "hematology",
        "names": ["hemoglobin", "haemoglobin", "hb"],
        "aliases": ["hgb"],
        "keywords": ["anemia", "fatigue", "blood count", "oxygen carrying"],
        "related": ["ferritin", "mcv", "rdw", "vitamin b12"],
        "source": "WHO Haemoglobin Concentrations for Anaemia Diagnosis 2024 update",
        "url": "https://www.who.int/publications",
        "title": "Hemoglobin Thresholds and Anemia Severity",
        "level": "A",
        "updated": "2024-03",
    },
    {
        "id": "platelet-ash-2023",
        "category": "hematology",
        "names": ["platelet count", "platelets", "thrombocyte count"],
        "aliases": ["plt", "thrombocytes"],
        "keywords": ["bleeding risk", "thrombocytopenia", "thrombocytosis", "clot risk"],
        "related": ["wbc", "hemoglobin", "peripheral smear"],
        "source": "American Society of Hematology Guidance 2023",
        "url": "https://www.hematology.org/education/clinicians/guidelines-quality",
        "title": "Platelet Count Clinical Context",
        "level": "B",
        "updated": "2023-07",
    },
    {
        "id": "ferritin-bsh-2023",
        "category": "hematology",
        "names": ["ferritin", "serum ferritin"],
        "aliases": ["iron store ferritin"],
        "keywords": ["iron deficiency", "anemia workup", "inflammation marker"],
        "related": ["hemoglobin", "transferrin saturation", "crp", "mcv"],
        "source": "British Society for Haematology Iron Deficiency Guidance 2023",
        "url": "https://b-s-h.org.uk/guidelines",
        "title": "Ferritin in Iron Deficiency Workup",
        "level": "B",
        "updated": "2023-09",
    },
    {
        "id": "vitamin-b12-efns-2024",
        "category": "vitamins",
        "names": ["vitamin b12", "cobalamin", "b12"],
        "aliases": ["serum b12"],
        "keywords": ["neuropathy", "macrocytosis", "fatigue", "deficiency"],
        "related": ["hemoglobin", "mcv", "folate", "homocysteine"],
        "source": "EFNS Clinical Guidance on B12 Deficiency 2024",
        "url": "https://www.ean.org/guideline-reference-center",
        "title": "Vitamin B12 Deficiency Interpretation",
        "level": "B",
        "updated": "2024-02",
    },
    {
        "id": "hs-crp-aha-2023",
        "category": "inflammation",
        "names": ["hs-crp", "high sensitivity c-reactive protein", "crp"],
        "aliases": ["high sensitivity crp", "c-reactive protein"],
        "keywords": ["inflammation", "cardiovascular risk", "acute infection"],
        "related": ["ldl", "triglycerides", "ferritin"],
        "source": "AHA/CDC Scientific Statement on CRP 2023",
        "url": "https://www.ahajournals.org",
        "title": "hs-CRP Risk Interpretation",
        "level": "A",
        "updated": "2023-03",
    },
    {
        "id": "uric-acid-acr-2023",
        "category": "metabolic",
        "names": ["uric acid", "serum urate"],
        "aliases": ["urate"],
        "keywords": ["gout", "hyperuricemia", "metabolic risk", "renal stone"],
        "related": ["creatinine", "egfr", "crp"],
        "source": "American College of Rheumatology Gout Guideline 2023",
        "url": "https://rheumatology.org",
        "title": "Serum Uric Acid and Gout Risk Context",
        "level": "B",
        "updated": "2023-11",
    },
]
