"""casebook.operators"""
