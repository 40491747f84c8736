"""casebook.sources"""
