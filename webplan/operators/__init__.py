"""webplan.operators"""
