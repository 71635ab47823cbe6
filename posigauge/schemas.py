"""Explicit schemas for landed files. Raw columns are text; casts come later."""

from pyspark.sql import types as T


def text_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# --- fixed values: column names of the landed files -------------------------
TESTS = text_schema(
    "testType",
    "patientId",
    "result",
    "collectedDate",
    "reportedDate",
    "orderCreatedAt",
    "resultCreatedAt",
    "ageRange",
    "region",
)
DEATHS = text_schema("TX_GRUPO_EDAD", "FE_MUERTE", "CO_CLASIFICACION", "CO_SEXO")
DEATHS_SUMMARY = text_schema("deathDate", "reportDate", "ageRange")
LEGACY_HOSPITAL = text_schema("Fecha", "HospitCOV19", "CamasICU_disp", "CamasICU")
VACCINES = text_schema(
    "location",
    "date",
    "total_distributed",
    "total_vaccinations",
    "people_vaccinated",
    "people_fully_vaccinated",
)
HOSPITAL_COUNTERS = [
    "CAMAS_ADULTOS_COVID",
    "CAMAS_ADULTOS_NOCOVID",
    "CAMAS_ADULTOS_OCC",
    "CAMAS_ADULTOS_DISP",
    "CAMAS_ADULTOS_TOTAL",
    "CAMAS_ICU_COVID",
    "CAMAS_ICU_NOCOVID",
    "CAMAS_ICU_OCC",
    "CAMAS_ICU_DISP",
    "CAMAS_ICU_TOTAL",
    "CAMAS_PED_COVID",
    "CAMAS_PED_NOCOVID",
    "CAMAS_PED_OCC",
    "CAMAS_PED_DISP",
    "CAMAS_PED_TOTAL",
    "CAMAS_PICU_COVID",
    "CAMAS_PICU_NOCOVID",
    "CAMAS_PICU_OCC",
    "CAMAS_PICU_DISP",
    "CAMAS_PICU_TOTAL",
    "VENT_ADULTOS_COVID",
    "VENT_ADULTOS_NOCOVID",
    "VENT_ADULTOS_OCC",
    "VENT_ADULTOS_DISP",
    "VENT_ADULTOS_TOTAL",
    "VENT_PED_COVID",
    "VENT_PED_NOCOVID",
    "VENT_PED_OCC",
    "VENT_PED_DISP",
    "VENT_PED_TOTAL",
    "CUARTOS_PRESNEG_OCC",
    "CUARTOS_PRESNEG_DISP",
    "CUARTOS_PRESNEG_TOTAL",
    "VENT_ORD",
    "VENT_REC",
    "VENT_ENTR",
    "CONVALECIENTES",
]
HOSPITAL = text_schema("FE_REPORTE", *HOSPITAL_COUNTERS)
DAILY_GOLDEN = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("HTPos", T.LongType()),
        T.StructField("HTTotal", T.LongType()),
        T.StructField("HTAvgDaily", T.DoubleType()),
        T.StructField("MolecularPos", T.LongType()),
        T.StructField("MolecularTotal", T.LongType()),
        T.StructField("MolecularAvgDaily", T.DoubleType()),
    ]
)
# ----------------------------------------------------------------------------
