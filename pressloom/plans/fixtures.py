"""Relations for the registered queries, made of the given tables by plain SQL.

The statements run in Spark and in other SQL engines alike. ``documents`` get a
Spanish lead sentence by their number, so every rule has rows, and the keys of
a press archive. All rows and whole texts stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LEADS = (
    "El femicidio de una joven conmociona a la provincia.",
    "Marcha contra la violencia contra las mujeres en la plaza.",
    "El machismo y la misoginia en los medios.",
    "Hallaron el cuerpo de una mujer en un descampado.",
    "Buscan a una joven desaparecida desde el lunes.",
    "Una mujer con heridas de arma blanca fue internada.",
    "Una mujer murió ahogada en el río.",
    "La mujer declaró por el homicidio.",
    "La violencia doméstica afecta a la mujer.",
    "Un choque dejó con lesiones a una mujer. Hubo incendio y derrumbe.",
    "Un hombre murió tras el ataque y la mujer tiene lesiones.",
    "La mujer asesinó a su esposo en la casa.",
    "Una mujer fue asesinada por su expareja.",
    "El hombre violó a la joven en el barrio.",
    "La joven que denuncia de violación al profesor pidió justicia. La mujer espera.",
    "Una joven desaparecida. Su pareja declaró ayer.",
    "La madre fue golpeada y había denunciado amenazas de muerte.",
    "El acusado golpeó a la mujer con un palo.",
    "Su novio mató a la mujer, según el imputado.",
    "La novia apuñaló a su novio. La mujer fue asesinada después.",
    "Detuvieron a la madre de la niña.",
    "La tía golpeó a la niña; la mujer tiene lesiones.",
    "Muerte violenta de una mujer en el norte.",
    "Se sospecha que la mujer cometió el crimen.",
    "Newsletter de la mujer desaparecida.",
    "Una mujer apareció muerta en un siniestro vial; su esposo declaró.",
    "La adolescente hallada muerta tenía signos de violencia.",
    "La mujer y su marido viajaron al festival.",
    "El crimen de la joven sigue impune. Su hermano y su padre reclaman.",
    "La violencia física contra una mujer y el acoso digital.",
    "Feminicidio: la mujer asesinada lo había denunciado.",
    "El temporal llegó a la costa",
)
_lead = " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(LEADS))

ARTICLES = f"""
SELECT doc_id,
  CASE doc_id % 5 WHEN 0 THEN 'eluniversal_mx' WHEN 1 THEN 'diario_norte' WHEN 2 THEN 'diario_sur' WHEN 3 THEN 'la_gaceta' ELSE 'el_correo' END AS source,
  CASE lang WHEN 'es' THEN 'Argentina' WHEN 'en' THEN 'Argentina' WHEN 'fr' THEN 'México' ELSE NULL END AS country,
  CASE WHEN doc_id % 53 = 7 THEN NULL ELSE CAST(2014 + doc_id % 7 AS string) || '0315' || CAST(100000 + doc_id % 86399 % 24 * 10000 % 140000 AS string) END AS snapshot_timestamp,
  CAST(2014 + doc_id % 7 AS string) || '_03' AS run_id,
  CASE WHEN doc_id % 61 = 5 THEN '' ELSE 'http://' || source || '.example.com/nota/' || CAST(doc_id % 700 AS string) END AS normalized_url,
  CASE WHEN doc_id % 61 = 5 THEN NULL ELSE 'https://www.' || source || '.example.com/nota/' || CAST(doc_id % 700 AS string) || '?x=1' END AS candidate_url,
  CASE doc_id % 4 WHEN 0 THEN 'Policiales' WHEN 1 THEN ' Una joven espera ' ELSE 'Noticias de la región' END AS anchor_text,
  CASE doc_id % 6 WHEN 0 THEN 'El niÃ±o de la ciudad' WHEN 1 THEN '  Hoy   en la plaza ' WHEN 2 THEN NULL ELSE 'Noticia ' || CAST(doc_id % 90 AS string) END AS title,
  CASE WHEN doc_id % 40 < {len(LEADS)} THEN CASE doc_id % 40 {_lead} END || chr(10) ELSE '' END
    || CASE doc_id % 9 WHEN 0 THEN 'Compartir en Facebook' || chr(10) WHEN 1 THEN '-' || chr(10) || 'Flipear' || chr(10) || 'Revista semanal' || chr(10) ELSE '' END
    || coalesce(text, '') AS text,
  CASE WHEN doc_id % 23 = 4 THEN 'HTTPError: 503' WHEN doc_id % 29 = 6 THEN 'TimeoutError: timed out' ELSE NULL END AS fetch_error
FROM {{documents}}
"""

#: Pages as links: the heading is the anchor; some addresses get what a filter rejects.
CANDIDATES = """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'diario_norte' WHEN 1 THEN 'diario_sur' ELSE 'la_gaceta' END AS source, 'Argentina' AS country,
  CAST(20150101000000 + page_id % 28 * 1000000 AS string) AS snapshot_timestamp, 'http://example.com/' AS homepage_url,
  CASE page_id % 11 WHEN 0 THEN url || '/tag/x' WHEN 1 THEN url || '/nota/final.pdf' WHEN 2 THEN NULL WHEN 3 THEN 'HTTPS://WWW.Example.com:443/Nota/' || CAST(page_id % 5 AS string) || '/a//' ELSE replace(url, '#top', '') || '/nota/' || CAST(page_id % 40 AS string) || '/texto' END AS candidate_url,
  CASE page_id % 13 WHEN 0 THEN 'Inicio' WHEN 1 THEN '  deportes  ' WHEN 2 THEN NULL ELSE 'Una noticia de la plaza ' || CAST(page_id % 17 AS string) END AS anchor_text
FROM {pages}
"""

#: Events as captures of an index, with repeats.
CAPTURES = """
SELECT substring(replace(replace(replace(CAST(ts AS string), '-', ''), ':', ''), ' ', ''), 1, 14) AS timestamp, 'http://' || event_type || '.example.com/' AS original,
  CASE WHEN user_id % 17 = 3 THEN '404' ELSE '200' END AS statuscode, 'text/html' AS mimetype, CAST(user_id % 40 AS string) AS digest, event_type AS source,
  CASE event_type WHEN 'click' THEN 'Argentina' WHEN 'view' THEN 'México' WHEN 'error' THEN NULL ELSE 'Argentina' END AS country,
  substring(replace(CAST(ts AS string), '-', ''), 1, 8) AS query_day, substring(CAST(ts AS string), 1, 4) AS year, event_id
FROM {events}
"""

#: Labels of documents as a reviewed sample.
REVIEWED = """
SELECT d.doc_id, CASE WHEN d.lang = 'de' THEN 'hard_negative' ELSE d.lang END AS validation_group,
  CASE WHEN l.doc_id IS NULL THEN CASE d.doc_id % 3 WHEN 0 THEN ' Uncertain ' ELSE '' END WHEN l.quality = 1 THEN 'Relevant' ELSE 'not_relevant' END AS manual_case_label,
  CASE d.doc_id % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'contextual' WHEN 2 THEN 'Insufficient ' ELSE NULL END AS manual_gender_recognition,
  CASE WHEN d.doc_id % 7 = 0 THEN 'bad' ELSE CAST(1 + d.doc_id % 5 AS string) END AS sample_weight
FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id
"""

DECISIONS = """
SELECT 'http://' || source || '.example.com/nota/' || CAST(doc_id % 700 AS string) AS article_key,
  CASE doc_id % 4 WHEN 0 THEN ' Exclude' WHEN 1 THEN 'include' WHEN 2 THEN 'review' ELSE '' END AS manual_scope_decision, doc_id AS ordinal
FROM {documents}
"""


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the tables in a folder."""
    names = [t for t in ("documents", "pages", "events", "labels") if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def plain(sql: str) -> str:
    """The statement over tables of those names."""
    for t in ("documents", "pages", "events", "labels"):
        sql = sql.replace("{" + t + "}", t)
    return sql
