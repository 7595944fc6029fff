"""webplan.sources"""
