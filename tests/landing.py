"""The hand-made raw files: every row is an edge case."""

import gzip
import json

TITLES = """tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres
tt0000001\tshort\t"Unclosed quote\t"Unclosed quote\t0\t1894\t\\N\t1\tDocumentary,Short
tt0000002\tmovie\tÉlan\tÉlan\t1\t\\N\t\\N\t90\t\\N
tt0000003\ttvSeries\tC\tC\t0\t1990\t1995\t\\N\tDrama
tt0000004\tmovie\tD\tD\t0\t2999\t\\N\t80\tDrama
tt0000005\tmovie\tE  e\tE\t0\t1901\t\\N\t70\tSci Fi,Short
tt0000006\tmovie\tF\tF\t0\t1900\t\\N\t70\tShort
"""
TITLE_CREW = """tconst\tdirectors\twriters
tt0000001\tnm0000001,nm0000002\tnm0000001
tt0000002\tnm0000003\t\\N
tt0000003\t\\N\t\\N
tt0000004\txx01\tnm0000004
"""
PEOPLE = """nconst\tprimaryName\tbirthYear\tdeathYear\tprimaryProfession\tknownForTitles
nm0000001\tFred Astaire\t1899\t1987\tactor,producer\ttt0000001,tt0000002
nm0000002\tB\t1990\t1980\tactor\ttt0000001
nm0000003\tC\t\\N\t\\N\t\\N\ttt0000002
nm0000004\tD\t1950\t\\N\twriter\t\\N
"""
MOVIES = """0000008::Edison Kinetoscopic Record (1894)::Documentary|Short
0000010::La sortie  des usines (1895)::
0000099::Amélie::Comedy|Romance
0000099::Amélie::Comedy|Romance
"""
USERS = "1::139564917\n2::NA\n"
RATINGS = "1::0000008::8::1381006850\n1::0000010::11::1381006851\n2::0000099::abc::xyz\n2::0000001::7::1381006852\n"
LINKS = "movieId,imdbId,tmdbId\n1,0000001,5\n2,0000002,5\n3,0000003,\n"
CREW_DETAIL = {
    "nm0000001": {"imdb_id": "nm0000001", "tmdb_data": {
        "id": 30, "name": "Fred", "original_name": "Fréd", "adult": False, "popularity": 4.5, "gender": 2,
        "known_for": [{"id": 5, "popularity": 1.5}, {"id": 77, "popularity": 2.0}]}},
    "nm0000002": None,
    "nm0000003": {"imdb_id": "nm0000003", "tmdb_data": {
        "id": 31, "name": "Ñ", "adult": True, "popularity": 0.1, "gender": 0, "known_for": []}},
}


def write(folder):
    for name, text in (("title.basics", TITLES), ("title.crew", TITLE_CREW), ("name.basics", PEOPLE)):
        with gzip.open(folder / f"{name}.tsv.gz", "wt", encoding="utf8") as f:
            f.write(text)
    for name, text in (("movies.dat", MOVIES), ("users.dat", USERS), ("ratings.dat", RATINGS), ("links.csv", LINKS),
                       ("crew_data.json", json.dumps(CREW_DETAIL, indent=2))):
        (folder / name).write_text(text, encoding="utf8")
    return str(folder)
