"""Confix stripping, a case for each rule, and in a column."""

import pytest
from pyspark.sql import functions as F

from retrievo.functions import stemming
from retrievo.functions import text as tx

ROOTS = "ajar baca beli buat cari cuci dengar duduk gambar hitung ikut jalan kerja kirim lihat makan masak nyanyi pakai pukul rasa sapu satu sewa tari terbang tulis ubah warna bom ambil".split()

CASES = {
    # particles, possessives, derivational suffixes, several of them
    "bacalah": "baca", "bacakah": "baca", "bacatah": "baca", "apapun": "apapun", "bukunya": "bukunya", "gambarku": "gambar", "gambarmu": "gambar", "gambarnyalah": "gambar", "makanan": "makan",
    "belikan": "beli", "jalani": "jalan", "tulisannya": "tulis",
    # plain prefixes
    "dibaca": "baca", "kesatu": "satu", "sejalan": "jalan",
    # ber-, ter-, per-, and those that lose their r
    "berjalan": "jalan", "bekerja": "kerja", "belajar": "ajar", "terbaca": "baca", "terasa": "rasa", "perjalanan": "jalan", "pelajaran": "ajar", "pekerja": "kerja",
    # me- and pe- before each sound
    "membaca": "baca", "memukul": "pukul", "memakai": "pakai", "memasak": "masak", "mencari": "cari", "mendengar": "dengar", "menjalankan": "jalan", "menulis": "tulis", "menari": "tari",
    "menyapu": "sapu", "menyewakan": "sewa", "menggambar": "gambar", "menghitung": "hitung", "mengirim": "kirim", "mengubah": "ubah", "mengambil": "ambil", "mengebom": "bom", "melihat": "lihat",
    "merasakan": "rasa", "mewarnai": "warna", "menyanyi": "nyanyi",
    "pembaca": "baca", "pemukul": "pukul", "pencari": "cari", "penulis": "tulis", "penyewa": "sewa", "penggambaran": "gambar", "pengirim": "kirim", "pelihat": "lihat",
    # several prefixes
    "diperdengarkan": "dengar", "keterbacaan": "baca", "memperjalankan": "jalan", "berpakaian": "pakai",
    # prefixes and suffixes that don't go together, roots, short words, words of other languages
    "dimakanan": "dimakanan", "terbang": "terbang", "dia": "dia", "hospital": "hospital", "": "",
}


@pytest.mark.parametrize("word", CASES)
def test_word(word):
    assert stemming.Stemmer(ROOTS)(word) == CASES[word]


def test_column(spark):
    rows = spark.createDataFrame([(1, "Membaca dan menulis"), (2, ""), (3, None)], "id int, text string")
    words = tx.without(tx.tokens(F.col("text")), ["dan"])
    got = {r.id: r.s for r in rows.select("id", tx.stemmed(words, stemming.Stemmer(ROOTS)).alias("s")).collect()}
    assert got == {1: ["baca", "tulis"], 2: [], 3: []}
